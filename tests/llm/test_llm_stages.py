"""Every stage of the pipeline on nulls, empty texts, repeated rows, clashing columns, and an empty table."""

import corpus_pipeline
from pyspark.sql import functions as F

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, "alpha beta gamma delta epsilon zeta", None, None),
    (3, None, "de", "b"), (4, "", "de", "b"), (None, "some other words that stand alone here", "en", "a"), (6, "x " * 50_000, "fr", None),
]
CLASH = ("toxic", "_id", "_nth", "nth", "k_text", "copy", "rows", "row", "known", "label", "hash")


def test_stages_on_odd_rows(spark, small):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH})
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).collect()
        ids = sorted((r["doc_id"] for r in out), key=str)
        if name in ("toxicity", "lines"):
            assert ids == [1, 1, 2, 3, 4, 6, None]
        elif name == "near_duplicates":
            assert ids == [1, 3, 4, 6, None]
        elif name == "benchmark":
            assert ids == [1, 1, 2, 3, 4, 6, None]
        else:
            assert not {3, 4} & set(ids)
        if name != "mixture":
            assert stage(spark, docs, small).columns == docs.columns


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0 and (name == "mixture" or out.columns == docs.columns)
