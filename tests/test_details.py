"""Loads, stores, manifests, gates and batches on small fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import expr as E
from corpusmill.operators import manifests, paging, search, xref
from corpusmill.plans import registry, text_queries
from corpusmill.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_load_modes(spark):
    loaded = spark.createDataFrame([("a.apk",), ("a.apk",), ("b.jar",)], "path string")
    asked = spark.createDataFrame([("a.apk", True), ("c.dex", False), ("d.txt", True), ("e.ZIP", True), ("e.ZIP", True), (None, True)], "path string, there boolean")
    assert dict(rows(files.load_files(loaded, asked))) == {"a.apk": "kept", "b.jar": "kept", "c.dex": "missing", "d.txt": "unsupported", "e.ZIP": "added", None: "missing"}
    assert dict(rows(files.load_files(loaded, asked, "replace"))) == {"a.apk": "added", "b.jar": "dropped", "c.dex": "missing", "d.txt": "unsupported", "e.ZIP": "added", None: "missing"}
    with pytest.raises(ValueError):
        files.load_files(loaded, asked, "other")


def test_code_chain_skips_what_is_damaged(spark, tmp_path):
    code = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "class_id long, code string")
    files.put_code(code, str(tmp_path / "good"))
    spark.read.parquet(str(tmp_path / "good")).withColumn("code", F.when(F.col("class_id") == 2, "bad").otherwise(F.col("code"))).write.parquet(str(tmp_path / "damaged"))
    stored = files.get_code(spark, str(tmp_path / "damaged"))
    cache = code.where("class_id = 4").withColumn("code", F.lit("hot"))
    got = rows(files.code_chain(code, [("cache", cache), ("store", stored)]))
    assert got == [(1, "store", "a"), (2, "unreadable", None), (3, "unreadable", None), (4, "cache", "hot")]


def test_edges_are_stale_for_other_classes_and_when_damaged(spark, tmp_path):
    edge = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    files.put_edges(edge, str(tmp_path / "e"), 3)
    assert rows(files.get_edges(spark, str(tmp_path / "e"), 3)) == [("a", "b"), ("b", "c")]
    assert files.get_edges(spark, str(tmp_path / "e"), 4) is None
    spark.createDataFrame([("a", "b", 1)], "src string, dst string, digest long").write.mode("append").parquet(str(tmp_path / "e" / "edges"))
    assert rows(files.get_edges(spark, str(tmp_path / "e"), 3)) == [("a", "b"), ("b", "c")]
    spark.createDataFrame([("b", "c", 1)], "src string, dst string, digest long").write.mode("overwrite").parquet(str(tmp_path / "e" / "edges"))
    assert files.get_edges(spark, str(tmp_path / "e"), 3) is None


def test_manifest_with_several_of_everything(spark):
    xml = """<manifest><uses-sdk targetSdkVersion="30"/><uses-permission name="CAMERA"/><uses-permission name="CAMERA"/><permission name="p"/><permission name="q" protectionLevel="0x12"/>
      <permission name="r" protectionLevel="1"/><activity name="A"><intent-filter><data scheme="s"/><data scheme="t" host="h"/><data scheme="u" host="h" path="/x"/></intent-filter></activity>
      <provider name="P"><intent-filter/></provider><provider name="Q" exported="true"/><service name="S" exported="false"><intent-filter/></service></manifest>"""
    own = spark.createDataFrame([(1, xml), (2, "<manifest/>"), (3, None), (4, xml.replace('"30"', '"31"'))], "id int, xml string")
    assert rows(manifests.exported(own)) == [(1, "activity", "A", "implicit"), (1, "provider", "Q", "explicit"), (4, "provider", "Q", "explicit")]
    assert rows(manifests.custom_permissions(own.where("id < 4"))) == [(1, "p", "normal"), (1, "q", "signature"), (1, "r", "dangerous")]
    assert rows(manifests.used_permissions(own.where("id < 4"), ["CAMERA"])) == [(1, "CAMERA")]
    assert rows(manifests.deeplinks(own.where("id < 4"))) == [(1, "s://"), (1, "t://h"), (1, "u://h/x")]


def test_archive_lines(spark):
    body = spark.createDataFrame([(1, "A: b\n c\r\n d\r\nB-C: x: y\nnone\n: z"), (2, ""), (3, None)], "id int, body string")
    assert rows(manifests.attributes(body)) == [(1, "A", "bcd"), (1, "B-C", "x: y")]
    lines = spark.createDataFrame([(1, 1, "# a=1"), (1, 2, " k = 1 "), (1, 3, "k=2=3"), (1, 4, "!x=1"), (1, 5, "=v"), (2, 1, "e:")], "class_id long, line_no int, line string")
    assert rows(manifests.properties(lines)) == [(1, "k", "2=3"), (2, "e", "")]


def test_gate_and_batch(spark):
    cheap = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("a", "z")], "src string, dst string")
    first = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "src string, dst string")
    then = spark.createDataFrame([("a", "y"), ("a", "x")], "src string, dst string")
    got = rows(xref.gated(cheap, [("first", first), ("then", then)]))
    assert got == [("a", "x", "first"), ("a", "y", "then"), ("a", "z", "live"), ("b", "x", "first"), ("c", "x", "first")]
    asked = spark.createDataFrame([(0, "class:x"), (1, None), (2, "method:a:nope"), (3, ""), (10, "class:x")], "ord int, item string")
    assert [r["status"] for r in xref.batch(asked, cheap).orderBy("ord").collect()] == ["ok", "bad request", "not found", "bad request", "too many"]


def test_names_hashes_windows(spark):
    own = spark.createDataFrame([("class", 1, "ab", 1), ("field", 3, "ab", 2), ("field", 3, "abc", 3)], "kind string, kind_rank int, name string, id long")
    assert rows(search.indexed_names(own, "AB")) == [("class", "ab", "display"), ("field", "abc", None)]
    assert all(search.indexed_names(own, t) is None for t in ("a b", "a.b", "a*", "a?", "")) and search.indexed_names(own, "a", ("code",)) is None
    texts = spark.createDataFrame([("",), ("Aa",), ("BB",), ("hello world",)], "t string")
    assert [r[0] for r in texts.select(E.string_hash(F.col("t"))).collect()] == ["0", "840", "840", "6aefe2c4"]
    assert tuple(paging.search_window(own, 1, 1).first()) == (3, 1, 2, True)
    assert tuple(paging.search_window(own.where("false")).first()) == (0, 0, 0, False)


def test_blocks_open_at_ascii_word_ends(spark, tmp_path):
    lines = ["before", "Inüber x", "own", "Of", "", "The_a", "Theß b", "And9", "And. c", "Int", " In d", "In\u0301 e", "Of\td"]
    spark.createDataFrame([(1, "\n".join(lines), "s", "de", 9), (2, None, "s", "de", 0), (3, "no\nInn", "s", "de", 6)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = text_queries.block_splitter(spark, str(tmp_path)).select("class_id", "block", "n_lines", "head")
    want = con.execute(f"SELECT class_id, block, n_lines, head FROM ({registry.SQL['block_splitter']})").fetchall()
    assert rows(got) == sorted(want, key=repr) and len(want) == 6
