"""Reference graphs: edges, degrees, layered reachability and paths."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoints(df: DataFrame) -> None:
    """Names a checkpoint folder if the session has none; spark.checkpoint.dir, where set, is shared by all executors. A temporary
    folder does in local mode alone."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusmill-"))


def edges(usage: DataFrame) -> DataFrame:
    """src (referrer), dst (target): distinct, without self references."""
    return usage.select(F.col("referrer").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()


def within(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    return edge.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def transpose(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def layers(edge: DataFrame, start: str, depth: int = 3, cap: int = 2_000) -> DataFrame:
    """node, depth, truncated: nodes that start reaches in at most ``depth`` (1 to 12) steps, at their least depth.

    Start is left out. Of more than ``cap`` nodes the first by depth and name are kept; truncated says that the cap was
    reached, also exactly. Each level is checkpointed; only its emptiness is known to the driver.
    """
    checkpoints(edge)
    spark = edge.sparkSession
    # each level reads the edges once more: by src, as they are joined
    edge = edge.repartition("src").checkpoint()
    frontier = spark.createDataFrame([(start,)], "node string")
    seen, out = frontier, spark.createDataFrame([], "node string, depth int")
    for level in range(1, min(max(depth, 1), 12) + 1):
        step = edge.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").checkpoint()
        if not frontier.limit(1).count():
            break
        seen, out = seen.union(frontier), out.union(frontier.select("node", F.lit(level).alias("depth")))
    total = out.agg(F.count("*")).scalar()
    return out.orderBy("depth", "node").limit(min(max(cap, 1), 50_000)).withColumn("truncated", total >= cap)


def expanded(edge: DataFrame, start: str, depth: int, cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth) from start on, start included, and the edges out of those above the last depth."""
    reached = layers(edge, start, depth, cap).select("node", "depth")
    nodes = edge.sparkSession.createDataFrame([(start, 0)], "node string, depth int").union(reached)
    inner = nodes.where(F.col("depth") < depth).select(F.col("node").alias("src"), "depth")
    return nodes, edge.join(inner, "src").select("src", "dst", "depth")


def paths(edge: DataFrame, start: str, ends: list[str], depth: int, fan: int = 10, reverse: bool = False) -> DataFrame:
    """path, depth, flagged: every step of a walk from start, as in a call tree.

    A node occurs once for each way it is met, but is expanded only where it is met first (least depth, then
    path); of its callees the first ``fan`` by name are followed. flagged: the last node of a path is one of ends.
    """
    checkpoints(edge)
    spark = edge.sparkSession
    out_edges = edge.select("src", "dst").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("rank") <= fan).checkpoint()
    level = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen, out = level.select("node").limit(0), None
    for d in range(1, depth + 1):
        first = level.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        seen = seen.union(first.select("node"))
        step = out_edges.join(first.withColumnRenamed("node", "src"), "src")
        level = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).checkpoint()
        own = level.select("node", "path", F.lit(d).alias("depth"))
        out = own if out is None else out.union(own)
    path = F.reverse("path") if reverse else F.col("path")
    return out.select(F.array_join(path, " > ").alias("path"), "depth", F.col("node").isin(*ends).alias("flagged"))
