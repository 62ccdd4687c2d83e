"""Files: allow-lists, listings, multi-file loads, and the stores of code and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes of files that can be loaded.
LOADABLE = [".apk", ".apks", ".xapk", ".apkm", ".aab", ".jar", ".dex", ".aar", ".class", ".zip"]


def loadable(path, suffixes: list[str] = LOADABLE):
    """Whether a path ends, in either case, in one of the suffixes."""
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True, suffixes: list[str] = LOADABLE) -> DataFrame:
    """name, size, loadable of the files under root, without dot files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.col("length").alias("size"), loadable(F.col("path"), suffixes).alias("loadable")).where(~F.col("name").startswith("."))


def append_files(loaded: DataFrame, more: DataFrame) -> DataFrame:
    """Files loaded so far and more, each path once."""
    return loaded.unionByName(more).dropDuplicates(["path"])


def load_files(loaded: DataFrame, asked: DataFrame, mode: str = "append") -> DataFrame:
    """path, status of a load of several files; one that can't be loaded doesn't stop the others.

    loaded: path; asked: path, there. Status: added, kept (loaded before), unsupported, missing. In replace mode files that
    aren't asked for again are dropped. A path that is asked for or loaded twice counts once; null paths count as missing.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"load mode {mode}")
    wanted = asked.groupBy("path").agg(F.bool_or("there").alias("there"))
    before = loaded.select("path").distinct().withColumn("was", F.lit(True))
    both = before.join(wanted.withColumn("wanted", F.lit(True)), "path", "full")
    status = F.when(F.col("wanted").isNull(), "kept" if mode == "append" else "dropped")
    if mode == "append":
        status = status.when(F.col("was"), "kept")
    status = status.when(~loadable(F.col("path")), "unsupported").when(F.coalesce("there", F.lit(False)) & F.col("path").isNotNull(), "added").otherwise("missing")
    return both.select("path", status.alias("status"))


def code_chain(classes: DataFrame, levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """class_id, origin, code: the code of each class from the first of the levels (class_id, code) that has it, else unreadable."""
    out = classes.select("class_id")
    for name, rows in levels:
        out = out.join(rows.select("class_id", F.col("code").alias(f"_{name}")), "class_id", "left")
    origin = F.coalesce(*(F.when(F.col(f"_{name}").isNotNull(), name) for name, _ in levels), F.lit("unreadable"))
    return out.select("class_id", origin.alias("origin"), F.coalesce(*(F.col(f"_{name}") for name, _ in levels)).alias("code"))


def put_code(code: DataFrame, path: str) -> None:
    """Writes class_id, code with a checksum; a row without code is not written."""
    code.where("code is not null").select("class_id", "code", F.crc32(F.col("code").cast("binary")).alias("crc")).write.mode("overwrite").parquet(path)


def get_code(spark: SparkSession, path: str) -> DataFrame:
    """class_id, code; a row whose checksum differs is a miss."""
    return spark.read.parquet(path).where(F.crc32(F.col("code").cast("binary")) == F.col("crc")).select("class_id", "code")


def put_postings(postings: DataFrame, path: str, files: int = 8) -> None:
    """Writes trigram, class_id in files of disjoint ranges, so that a lookup reads few row groups."""
    postings.repartitionByRange(files, "trigram").sortWithinPartitions("trigram", "class_id").write.mode("overwrite").parquet(path)


def get_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings; files that are corrupt or gone are left out."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def put_edges(edges: DataFrame, path: str, classes: int | None = None) -> None:
    """Writes src, dst with a checksum, sorted by dst, then a head of one row: how many edges there are, of how many classes."""
    digest = F.xxhash64("src", "dst").alias("digest")
    edges.select("src", "dst", digest).repartitionByRange("dst").sortWithinPartitions("dst").write.mode("overwrite").parquet(f"{path}/edges")
    head = edges.sparkSession.read.parquet(f"{path}/edges").agg(F.count("*").alias("n"), F.lit(classes).cast("long").alias("classes"))
    head.write.mode("overwrite").parquet(f"{path}/head")


def get_edges(spark: SparkSession, path: str, classes: int | None = None) -> DataFrame | None:
    """src, dst whose checksum fits; None if the graph was stored for another number of classes or lacks edges."""
    rows = spark.read.parquet(f"{path}/edges").where(F.xxhash64("src", "dst") == F.col("digest")).select("src", "dst")
    head = spark.read.parquet(f"{path}/head").first()
    return rows if head["classes"] == classes and head["n"] == rows.count() else None
