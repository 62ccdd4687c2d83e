"""Boundary cases of the operators on small fixtures, index paths against brute force."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import expr as E
from corpusmill.operators import graph, index, notes, paging, reports, rules, search, xref
from corpusmill.sources import files
from corpusmill.streaming.counts import windowed_counts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- index soundness


TEXTS = [(0, "Alpha beta"), (1, ""), (2, None), (3, "ab"), (4, "abc"), (5, "   \t  "), (6, "café ALPHA"), (7, "gamma abc alpha")]


@pytest.fixture(scope="module")
def indexed(spark):
    corpus = spark.createDataFrame(TEXTS, "class_id long, code string").withColumn("full_name", F.concat(F.lit("n"), "class_id"))
    return corpus, index.postings(corpus), index.coverage(corpus)


@pytest.mark.parametrize("term", ["alpha", "ABC", "a", "ab", "zzz", "fé al", "   ", "abc alpha", "caf"])
def test_verified_equals_brute_force(indexed, term):
    corpus, posted, states = indexed
    want = sorted(k for k, t in TEXTS if t is not None and term.lower() in t.lower())
    assert [r[0] for r in rows(index.verified(corpus, posted, states, term))] == want


@pytest.mark.parametrize("term", ["alpha", "abc", "zzz"])
def test_candidates_are_covered_and_hold_every_match(indexed, term):
    corpus, posted, states = indexed
    found = {r[0] for r in rows(index.candidates(posted, states, term))}
    assert found <= {r["class_id"] for r in states.where("state = 'covered'").collect()}
    assert {k for k, t in TEXTS if t and len(t) >= 3 and term in t.lower()} <= found


def test_coverage_states(spark, indexed):
    states = dict(rows(indexed[2]))
    assert states == {0: "covered", 1: "excluded", 2: "hole", 3: "excluded", 4: "covered", 5: "covered", 6: "covered", 7: "covered"}
    dead = index.coverage(indexed[0], spark.createDataFrame([(4,), (4,)], "class_id long"))
    assert dict(rows(dead))[4] == "tombstoned"


def test_lookup_states(indexed):
    _, posted, _ = indexed
    assert [tuple(r) for r in index.lookup_state(posted, "alpha").collect()] == [("candidates", 3)]
    assert [tuple(r) for r in index.lookup_state(posted, "qqqq").collect()] == [("cannot_narrow", 0)]
    assert [tuple(r) for r in index.lookup_state(posted, "abc beta").collect()][0][0] in ("empty", "cannot_narrow")


def test_broad_term_and_budget(indexed):
    corpus, posted, states = indexed
    found = index.candidates(posted, states, "alpha")
    assert rows(index.first_verified(corpus, found, "alpha", broad=2, sample=1)) == [(0, True)]
    assert rows(index.first_verified(corpus, found, "alpha", broad=3, sample=1)) == [(0, False), (6, False), (7, False)]
    assert [r["class_id"] for r in index.scanned(states, found, "alpha", 4).collect()] == [0, 6, 7, 2]


# --- graphs


def test_edges_and_layers(spark):
    usage = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("3", "1"), ("2", "2"), ("1", "2")], "referrer string, target string")
    edge = graph.edges(usage)
    assert rows(edge) == [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")]
    assert rows(graph.transpose(graph.transpose(edge))) == rows(edge)
    assert rows(graph.layers(edge, "1", 3)) == [("2", 1, False), ("3", 2, False), ("4", 3, False)]
    assert rows(graph.layers(edge, "9", 3)) == []
    assert rows(graph.within(edge, spark.createDataFrame([("1",), ("2",)], "node string"))) == [("1", "2")]


def test_cap_counts_as_truncated_when_reached(spark):
    star = spark.createDataFrame([("c", f"l{i}") for i in range(10)], "src string, dst string")
    assert {r["truncated"] for r in graph.layers(star, "c", 2, cap=10).collect()} == {True}
    assert {r["truncated"] for r in graph.layers(star, "c", 2, cap=11).collect()} == {False}
    assert graph.layers(star, "c", 2, cap=9).count() == 9


def test_paths_expand_a_node_once(spark):
    edge = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert rows(graph.paths(edge, "a", ["e"], 3)) == [("a > b", 1, False), ("a > b > d", 2, False), ("a > b > d > e", 3, True), ("a > c", 1, False), ("a > c > d", 2, False)]


# --- paging, packing, chunks


def test_pages_reassemble(spark):
    df = spark.range(25)
    pages = [[r[0] for r in paging.page(df, "id", offset=o, limit=7).collect()] for o in range(0, 28, 7)]
    assert sum(pages, []) == list(range(25))
    assert paging.page(df, "id", offset=25, limit=7).count() == 0
    assert paging.page(df, "id", offset=18, limit=0).count() == 7
    assert paging.page(spark.range(10_001), "id", limit=0).count() == 10_000


def test_page_info(spark):
    r = paging.page_info(spark.range(10_001), 0, 0).collect()[0]
    assert (r["total"], r["has_more"], r["next_offset"], r["prev_offset"]) == (10_001, True, 10_000, None)


def test_packing_is_greedy(spark):
    items = spark.createDataFrame([("g", 1, 40), ("g", 2, 40), ("g", 3, 40), ("g", 4, 500), ("g", 5, 10), ("h", 1, 600)], "g string, ord int, bytes int")
    assert rows(paging.pack(items, "g", "ord", "bytes", 100)) == [("g", 1, 0, False), ("g", 2, 0, False), ("g", 3, 1, False), ("g", 4, 2, True), ("g", 5, 3, False), ("h", 1, 0, True)]


def test_chunks_keep_characters_whole(spark):
    text = "é" * 10 + "a" + "日本" * 5
    got = paging.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t", 7).collect()
    assert "".join(r["text"] for r in got if r["id"] == 1) == text
    assert all(r["bytes"] <= 7 for r in got) and [r["chunk"] for r in got if r["id"] == 2] == [0]
    assert not [r for r in got if r["id"] == 3]


@pytest.mark.parametrize("total,start,chunk,want", [(100, 0, 8 << 20, [(0, 100, True)]), (25, 0, 10, [(0, 10, False), (10, 10, False), (20, 5, True)]), (25, 12, 10, [(12, 10, False), (22, 3, True)]), (100, 150, 10, [(100, 0, True)]), (0, 0, 10, [(0, 0, True)])])
def test_chunk_plan(spark, total, start, chunk, want):
    got = paging.chunk_plan(spark.createDataFrame([(total, start, chunk)], "total long, start long, chunk long"))
    assert [tuple(r)[3:] for r in got.orderBy("offset").collect()] == want


def test_eviction_keeps_the_current(spark):
    g = spark.createDataFrame([("a", 50, 1), ("b", 40, 2), ("c", 30, None)], "hash string, size long, last_used long")
    assert [r[0] for r in rows(paging.evict(g, 100, "c"))] == ["a"]
    assert rows(paging.evict(g, 200, "c")) == []


# --- text


def test_literals_with_lines(spark):
    df = spark.createDataFrame([(1, 'x "abcdefgh" \n "short" "ijklmnop"\n\n"qrstuvwx"'), (2, None)], "id int, t string")
    assert rows(search.literals(df, "id", "t")) == [(1, 1, "abcdefgh", 1), (1, 2, "ijklmnop", 2), (1, 3, "qrstuvwx", 4)]


def test_comments(spark):
    df = spark.createDataFrame([('a = "http://Needle"',), ("/* x\nneedle */",), ("needle",), ("// other",)], "code string")
    assert [r[0] for r in df.select(search.comment_matches(F.col("code"), "NEEDLE")).collect()] == [True, True, False, False]


@pytest.mark.parametrize("text", ["a\nb\nc", "", "\n\n", "one", "x\r\ny"])
def test_position_to_line(spark, text):
    df = spark.range(len(text) + 1).select("id", E.line_of(F.lit(text), F.col("id").cast("int")).alias("line"))
    assert {r["id"]: r["line"] for r in df.collect()} == {p: text[:p].count("\n") + 1 for p in range(len(text) + 1)}


def test_word_boundaries(spark):
    corpus = spark.createDataFrame([(1, "Foo Foo$Bar\nxFoo Foo_1\nimport Foo\nFoo,Foo"), (2, "nothing")], "class_id long, code string")
    edge = spark.createDataFrame([(1, 9), (2, 9)], "class_id long, target_id int")
    got = rows(xref.occurrences(edge, corpus, spark.createDataFrame([(9, "Foo")], "target_id int, word string")))
    assert got == [(9, 1, 1, 2), (9, 1, 4, 2), (9, 2, 0, 0)]


def test_as_of(spark):
    marks = spark.createDataFrame([(1, 3, "a"), (1, 7, "b")], "class_id int, at int, ref string")
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 6), (1, 9), (2, 5)], "class_id int, pos int")
    assert sorted(map(str, rows(xref.enclosing(asked, marks).fillna("-")))) == sorted(map(str, [(1, 2, "-"), (1, 3, "a"), (1, 6, "a"), (1, 9, "b"), (2, 5, "-")]))


def test_package_filter_bypass(spark):
    df = spark.createDataFrame([("a.b.C",), ("a.bc.D",)], "n string")
    count = lambda p: df.where(search.in_package(F.col("n"), p)).count()
    assert (count("a.b"), count(" "), count("defpackage"), count("p12.x"), count("a")) == (1, 2, 2, 2, 2)


def test_longest_prefix(spark):
    df = spark.createDataFrame([("com.google.firebase.X",), ("com.google.Y",), ("org.Z",)], "n string")
    got = dict(rows(rules.longest_prefix(df, "n", [("google", "com.google."), ("firebase", "com.google.firebase.")]).fillna("-")))
    assert got == {"com.google.firebase.X": "firebase", "com.google.Y": "google", "org.Z": "-"}


def test_names(spark):
    r = spark.range(1).select(
        E.jni_name(F.lit("a.b_c.D"), F.lit("go_on")), E.dotted(F.lit("Lx/y/Z;")), E.descriptor(F.lit("java.lang.String[][]")), E.package_of(F.lit("Plain")), E.package_of(F.lit("a.b.C")),
        E.parse_id(F.lit("0x7f01")), E.hex_id(F.lit(255)),
    ).collect()[0]
    assert tuple(r) == ("Java_a_b_1c_D_go_1on", "x.y.Z", "[[Ljava/lang/String;", "(default)", "a.b", 0x7F01, "0x000000ff")


# --- side tables, reports, files, streams


def test_notes_and_renames(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 3, "z", False), ("b", 4, None, True)], "key string, seq int, value string, deleted boolean")
    assert rows(notes.current(log, ["key"])) == [("a", 2, "y")]
    names = spark.createDataFrame([("p.A",), ("p.q.B",), ("pq.C",)], "full_name string")
    assert [r[1] for r in rows(notes.move_package(names, "p", "n.m"))] == ["n.m.A", "n.m.q.B", "pq.C"]


def test_report_escapes(spark):
    df = spark.createDataFrame([(2, "a|b"), (1, "x\ny")], "id int, t string")
    text = reports.markdown(reports.markdown_rows(df, "id", ["t"]), "id", ["t"]).collect()[0][0]
    assert text == "| t |\n|---|\n| x y |\n| a\\|b |"
    nodes, edges = spark.createDataFrame([('q"',)], "node string"), spark.createDataFrame([('q"', "z")], "src string, dst string")
    assert rows(reports.dot_lines(nodes, edges, 'q"')) == [('"q\\"" -> "z";',), ('"q\\"" [label="q\\" (root)"];',)]


def test_stores_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "alpha"), (2, None), (3, "")], "class_id long, code string")
    files.put_code(corpus, f"{tmp_path}/code")
    assert rows(files.get_code(spark, f"{tmp_path}/code")) == [(1, "alpha"), (3, "")]
    posted = index.postings(corpus)
    files.put_postings(posted, f"{tmp_path}/postings", 2)
    assert rows(files.get_postings(spark, f"{tmp_path}/postings")) == rows(posted)
    assert spark.createDataFrame([("A.JAR",), ("b.txt",)], "p string").where(files.loadable(F.col("p"))).count() == 1


def test_windowed_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counts").agg(F.sum("n")).collect()[0][0] == events.count()
    assert rows(spark.table("counts").select("start", "event_type", "n")) == rows(windowed_counts(events).select("start", "event_type", "n"))
