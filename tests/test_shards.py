"""The stored index: catalog, pruned union of shards, shards that are broken or gone."""

from pathlib import Path

import pytest

from corpusmill.operators import graph, rules
from corpusmill.sources import shards


def test_shards_round_trip_and_skip_what_is_broken(spark, tmp_path):
    rows = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x", j) for i in range(200) for j in range(3)]
    path = str(tmp_path / "index")
    assert shards.catalog(spark, path) is None and shards.get_shards(spark, path) is None
    shards.put_shards(spark.createDataFrame(rows, "trigram string, class_id long"), path, 4)
    known = shards.catalog(spark, path).collect()
    assert len(known) == 4 and sum(r["n"] for r in known) == 600
    assert all(a["high"] < b["low"] for a, b in zip(known, known[1:], strict=False))
    assert sorted(map(tuple, shards.get_shards(spark, path, check=True).collect())) == sorted(rows)
    files = [next(Path(f"{path}/shards").glob(r["shard"])) for r in known]
    files[0].unlink()
    files[1].write_bytes(b"no parquet")
    for f in Path(f"{path}/shards").glob(".*.crc"):
        f.unlink()
    spark.catalog.refreshByPath(f"{path}/shards")
    left = shards.get_shards(spark, path, check=True).collect()
    assert len(left) == known[2]["n"] + known[3]["n"] and min(r["trigram"] for r in left) == known[2]["low"]
    assert {r["shard"]: r["sound"] for r in shards.sound(spark, path).collect()} == {r["shard"]: i > 1 for i, r in enumerate(known)}


def test_places_round_trip(spark, tmp_path):
    rows = [(1, 5, 2, 1), (1, 6, 0, 0), (2, 5, 9, 3)]
    assert shards.get_places(spark, str(tmp_path / "none")) is None
    shards.put_places(spark.createDataFrame(rows, "target_id int, class_id long, line_no int, n long"), str(tmp_path / "p"))
    assert sorted(map(tuple, shards.get_places(spark, str(tmp_path / "p")).collect())) == rows


def test_scan_types(spark):
    classes = spark.createDataFrame([(1, "a.MyWebView"), (2, "b.Plain")], "class_id long, full_name string")
    lines = spark.createDataFrame([(2, 1, "String PASSWORD = x; Log.d(y)"), (2, 2, "ecb")], "class_id long, line_no int, line string")
    got = {t: sorted((r["rule"], r["class_id"], r["line_no"]) for r in rules.app_scan(classes, lines, t).collect()) for t in rules.SCAN_TYPES}
    assert got["secrets"] == [("data_leakage", 2, 1), ("hardcoded_secrets", 2, 1)]
    assert got["crypto"] == [("insecure_crypto", 2, 2)] and got["permissions"] == [("dangerous_apis", 1, 0)] and got["network"] == []
    assert sorted(sum((got[t] for t in rules.SCAN_TYPES[1:]), [])) == got["full"]
    with pytest.raises(ValueError):
        rules.app_scan(classes, lines, "other")


def test_layers_over_a_chain(spark):
    edge = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    got = [(r["node"], r["depth"]) for r in graph.layers(edge, "n0", 3).collect()]
    assert got == [("n1", 1), ("n2", 2), ("n3", 3)]
