"""What the training-data operators share: shipping code to workers, checkpoints, components."""

from __future__ import annotations

import gc
import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without an id sort after all others; this stands for their id inside an operator.
NO_ID = (1 << 63) - 1


#: Bytes of an Arrow batch, so that what a Python worker holds doesn't grow with the length of texts; a longer text goes alone.
BATCH_BYTES = 4 << 20
#: Edges of a task of components(), on average.
TASK_EDGES = 1_000_000
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, and name a checkpoint folder if the session has none.

    spark.checkpoint.dir, where set, is a folder that all executors share and stays as it is. Without it a temporary folder
    does in local mode, where all tasks see it; on a cluster that is an error. The size of Arrow batches is set where
    the session leaves it open.
    """
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="corpusmill-")).resolve() / "corpusmill_code.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package).as_posix()}")
        sc.addPyFile(str(name))
        _shipped.add(sc.applicationId)
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusmill-"))


def release(spark: SparkSession) -> None:
    """Give back the disk of shuffles that no frame needs any more, as those behind a checkpoint; else they stay until the JVM happens to collect."""
    gc.collect()
    spark.range(1).count()  # the scheduler holds what its last job read
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of edges a-b that aren't the smallest themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        # roots hook the smallest root that an edge of theirs leads to, then all nodes jump to their roots
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forests(batches):
    """The edges (a, b) of a task as stars: a leads to b, the smallest node that the task's edges connect it with."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += len(batch)
        if size > 2 * TASK_EDGES:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > TASK_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) connect each node with.

    Alternating stars. Small star: edges meet at their larger end, and what a task's edges connect becomes a star around its
    smallest node; a task gets about TASK_EDGES edges, so few edges are settled by one task. Large star: each edge moves
    to the smallest parent of its smaller end. Both keep what is connected; rounds grow with the logarithm of the longest way
    and end when all trees are stars, whatever their number. Each round is checkpointed, a lost executor costs one round.
    Nulls in a or b: the edge is dropped. An empty input gives an empty result.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ends = ends.checkpoint()
    while True:
        tasks = -(-ends.count() // TASK_EDGES)
        placed = ends.coalesce(1) if tasks <= 1 else ends.repartition(tasks, "a")
        stars = placed.mapInArrow(_forests, "a long, b long").checkpoint()
        if tasks <= 1:
            parents = stars.select("a", F.col("b").alias("m"))
            break
        parents = stars.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("other")).checkpoint()
        up = parents.select(F.col("a").alias("m"), F.col("m").alias("top"))
        if not parents.where("m < other").limit(1).count() and not parents.join(up, "m", "left_semi").limit(1).count():
            break
        jumped = stars.join(parents.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        ends = jumped.distinct().checkpoint()
    labels = parents.select(F.col("a").alias("node"), F.col("m").alias("label"))
    return labels.union(parents.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("label")))
