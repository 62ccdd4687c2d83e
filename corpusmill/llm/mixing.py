"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies: the source's target over its size. Documents
are lined up within their source by size, so that neighbours are alike, the expected copies are summed along the
line from one random offset, and a document is taken once for each whole number that its step crosses. The line is
cut into blocks (size class and a hash) that are numbered by a table of block counts; so no task orders a source.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the order of sources, and the share of all words to take.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Blocks of a size class; hashes of ids spread over them.
SPREAD = 32


def digest(*cols: Column) -> Column:
    """A whole number under 2^32 from the MD5 of the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target for each row of (source, source_size).

    Targets share ``share`` of all sizes by weight and stop at ``most`` times their source's size; the excess is
    shared by weight among the others, until none is above. That is to fill all at one level per weight, so
    sources are full in the order of size per weight, and two running sums give the level. One task holds a row
    for each source, a few numbers each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = most * F.col("source_size")
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = before.rowsBetween(0, Window.unboundedFollowing)
    done = F.coalesce(F.sum(full).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) * share - done) / F.sum("weight").over(rest)
    out = sizes.withColumn("weight", weight).withColumns({"level": level, "nth": F.row_number().over(before)})
    # the first source that its level doesn't fill, and all after it, stand at that level
    opens = F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct("nth", "level"))).over(every)
    return out.withColumn("at", opens["level"]).select(
        "source", "source_size", F.least(full.cast("double"), F.coalesce(F.col("at") * F.col("weight"), full.cast("double"))).alias("target")
    )


def copies(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size (words), source_size, target, copies, and the columns in keep: one row per row of docs.

    Null or empty texts have size 0 and are never taken. A null source is a source of its own, the last. Ties in
    size are ordered by a hash of the id; repeated rows are documents of their own. Null ids are kept. The result
    depends on seed and rows alone, not on partitions. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # names of this operator, so that columns in keep cannot clash with them
    line = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), digest(F.lit(str(seed)), key).alias("h"))
    block = {"class": F.floor(F.log2(F.col("size") + 1) * 4).cast("int"), "slot": (F.col("h") % SPREAD).cast("int"), "named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))}
    line = line.withColumns(block)
    keys = ["named", "source", "class", "slot"]
    blocks = line.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    # each source's blocks are 32 to a size class, some thousands whatever the size of the source
    blocks = blocks.checkpoint()
    words = blocks.groupBy(F.when(F.col("named"), F.col("source")).alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(words, weights, share, most).withColumns({"named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    before = Window.partitionBy("named", "source").orderBy("class", "slot").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("class") > 0, F.col("n")).otherwise(0)
    offset = blocks.withColumn("before", F.coalesce(F.sum(counted).over(before), F.lit(0))).join(goal, ["named", "source"])
    offset = offset.select(*keys, "before", "source_size", "target")
    order = Window.partitionBy(*keys).orderBy("size", "h", "doc_id")
    placed = line.withColumn("rank", F.row_number().over(order)).join(offset, keys)
    each = F.col("target") / F.greatest("source_size", F.lit(1))
    start = digest(F.lit(f"start{seed}"), F.col("named").cast("string"), F.col("source")) / 4294967296.0
    last = F.col("before") + F.col("rank")
    crossed = F.floor(start + last * each) - F.floor(start + (last - 1) * each)
    crossed = F.when(F.col("size") > 0, F.least(crossed, F.ceil(each))).otherwise(0).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", crossed.alias("copies"), *(F.col(f"k_{c}") for c in keep))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it is taken, with its number as copy_no (from 1)."""
    names = [c for c in docs.columns if c != "copy_no"]
    taken = copies(docs, seed, keep=tuple(names)).where("copies > 0")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no")
    return taken.select(*(F.col(f"k_{c}").alias(c) for c in names), number)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
