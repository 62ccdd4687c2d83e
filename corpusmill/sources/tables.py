"""Tables and the views of them that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """class_id, package, full_name, raw_name, simple_name, code, source, lang, n_chars: one row per document."""
    d = table(spark, root, "documents")
    package = F.concat_ws(".", "source", "lang")
    return d.select(
        F.col("doc_id").alias("class_id"), package.alias("package"), F.concat(package, F.lit(".D"), F.col("doc_id")).alias("full_name"),
        F.concat(F.lit("x."), F.col("source"), F.lit(".d"), F.col("doc_id")).alias("raw_name"), F.concat(F.lit("D"), F.col("doc_id")).alias("simple_name"),
        F.col("text").alias("code"), "source", "lang", "n_chars",
    )


def names(spark: SparkSession, root: str) -> DataFrame:
    """kind, kind_rank, name, id: the names of classes (parts), methods (customers) and fields (suppliers)."""
    parts = [("class", 1, "part", "p_name", "p_partkey"), ("method", 2, "customer", "c_name", "c_custkey"), ("field", 3, "supplier", "s_name", "s_suppkey")]
    out = None
    for kind, rank, of, name, key in parts:
        own = table(spark, root, of).select(F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"), F.col(name).alias("name"), F.col(key).alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


def usage(spark: SparkSession, root: str) -> DataFrame:
    """referrer, target: raw references, repeated and with self references, between lettered nodes."""
    o, li, c, n = (table(spark, root, t) for t in ("orders", "lineitem", "customer", "nation"))

    def node(letter: str, col: str):
        return F.concat(F.lit(letter), F.col(col))

    pairs = [
        o.select(node("o", "o_orderkey").alias("referrer"), node("c", "o_custkey").alias("target")),
        li.select(node("o", "l_orderkey").alias("referrer"), node("p", "l_partkey").alias("target")),
        li.select(node("o", "l_orderkey").alias("referrer"), node("s", "l_suppkey").alias("target")),
        c.select(node("c", "c_custkey").alias("referrer"), node("n", "c_nationkey").alias("target")),
        n.select(node("n", "n_nationkey").alias("referrer"), node("r", "n_regionkey").alias("target")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def parts_graph(spark: SparkSession, root: str) -> DataFrame:
    """src, dst: parts and suppliers that share a line, both ways."""
    li = table(spark, root, "lineitem")
    p, s = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return li.select(p.alias("src"), s.alias("dst")).union(li.select(s.alias("src"), p.alias("dst"))).distinct()


def calls(spark: SparkSession, root: str) -> DataFrame:
    """caller, callee, n: how often one event type follows another of the same user and value band."""
    from pyspark.sql import Window

    e = table(spark, root, "events")
    node = F.concat("event_type", F.lit("."), (F.floor(F.col("value")) % 10).cast("int"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = e.select(node.alias("caller"), F.lead(node).over(order).alias("callee"))
    return pairs.where("callee is not null").groupBy("caller", "callee").agg(F.count("*").alias("n"))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
