"""A corpus pipeline of five stages; each reads the rows that the one before it kept.

ORACLE_SQL is None: the first stage's classifier has no SQL. The tests hold each stage against a plain version.

Every stage takes an empty table and gives one; columns of docs, whatever their names, come through as they are. Null and empty texts stay
until the mixture, which takes no text without words. Rows with a null doc_id stay. Rows that repeat a doc_id stay until near_duplicates,
which leaves one of them; ties go to the smallest doc_id there, and to a hash of the id in the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import prepare, table
from corpusmill.llm.decontaminate import drop_contaminated
from corpusmill.llm.line_dedup import MIN_SITES, line_dedup
from corpusmill.llm.mixing import mix
from corpusmill.llm.near_duplicates import keep_one
from corpusmill.llm.toxicity import drop_toxic, fit

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents there are."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources and in as many distinct texts go; every document stays, n_chars follows the text.

    A document that was only copied to many sources keeps its text, so that the next stage has one to keep.
    """
    out = line_dedup(docs, min_texts=MIN_SITES)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents as often as their source's weight asks, numbered by copy_no."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows before it are written to the shared checkpoint folder and read again."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
