"""The trigram index as stored shards with a catalog.

A shard is a file of postings sorted by trigram; shards hold disjoint ranges, so a lookup reads the row groups of its
trigrams alone. The catalog has a row for each shard; a reader takes the shards whose rows agree with it and leaves out others.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoints

#: Version of the layout; a catalog of another one is stale.
VERSION = 1
_written: dict[tuple[str, str], str] = {}


def _summary(rows: DataFrame) -> DataFrame:
    """shard, n, low, high, digest: one row for each file of rows (trigram, class_id)."""
    each = rows.withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))
    digest = F.bit_xor(F.xxhash64("trigram", "class_id"))
    return each.groupBy("shard").agg(F.count("*").alias("n"), F.min("trigram").alias("low"), F.max("trigram").alias("high"), digest.alias("digest"))


def put_shards(postings: DataFrame, path: str, shards: int = 8) -> None:
    """Writes trigram, class_id as shards, then their catalog; an index without a catalog isn't there."""
    spark = postings.sparkSession
    placed = postings.select("trigram", "class_id").repartitionByRange(shards, "trigram").sortWithinPartitions("trigram", "class_id")
    placed.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/shards")
    _summary(spark.read.parquet(f"{path}/shards")).withColumn("version", F.lit(VERSION)).coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")


def catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """shard, n, low, high, digest in the order of their ranges; None if there is none or it is of another version."""
    try:
        found = spark.read.parquet(f"{path}/catalog")
    except AnalysisException:
        return None
    if "version" not in found.columns or found.where(F.col("version") != VERSION).limit(1).count():
        return None
    return found.drop("version").orderBy("low", "shard")


def sound(spark: SparkSession, path: str) -> DataFrame:
    """shard, sound: whether a shard can be read and its rows are those of the catalog; reads all shards once."""
    known = catalog(spark, path)
    if known is None:
        return spark.createDataFrame([], "shard string, sound boolean")
    there = spark.read.schema("trigram string, class_id long").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{path}/shards")
    now = _summary(there).select("shard", F.col("n").alias("m"), F.col("digest").alias("now"))
    same = F.coalesce((F.col("n") == F.col("m")) & F.col("digest").eqNullSafe(F.col("now")), F.lit(False))
    return known.join(now, "shard", "left").select("shard", same.alias("sound"))


def get_shards(spark: SparkSession, path: str, check: bool = False) -> DataFrame | None:
    """trigram, class_id of all shards together; None without a catalog. check: shards that aren't sound are left out."""
    if catalog(spark, path) is None:
        return None
    rows = spark.read.schema("trigram string, class_id long").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{path}/shards")
    if not check:
        return rows
    good = sound(spark, path).where("sound").select("shard")
    return rows.withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(good, "shard", "left_semi").select("trigram", "class_id")


def once(spark: SparkSession, kind: str, source: str, build, put) -> str:
    """Where a store of a source stands: put writes what build makes at the first use in an application, later ones read it."""
    key = (spark.sparkContext.applicationId, f"{kind}:{source}")
    if key not in _written:
        checkpoints(rows := build())
        path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
        put(rows, path)
        _written[key] = path
    return _written[key]


def stored(spark: SparkSession, source: str, build) -> DataFrame:
    """The index of a source; build makes the postings."""
    return get_shards(spark, once(spark, "index", source, build, put_shards))


def path_of(spark: SparkSession, source: str) -> str:
    """Where the index of a source stands that this application has written."""
    return _written[(spark.sparkContext.applicationId, f"index:{source}")]


def put_places(places: DataFrame, path: str) -> None:
    """Writes use places (target_id, class_id, line_no, n) sorted by target, each row with a checksum."""
    digest = F.xxhash64("target_id", "class_id", "line_no", "n").alias("digest")
    places.select("target_id", "class_id", "line_no", "n", digest).repartitionByRange("target_id", "class_id").sortWithinPartitions("target_id", "class_id", "line_no").write.mode("overwrite").parquet(path)


def get_places(spark: SparkSession, path: str) -> DataFrame | None:
    """Use places whose checksum fits; None if there are none stored."""
    try:
        rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return None
    return rows.where(F.xxhash64("target_id", "class_id", "line_no", "n") == F.col("digest")).drop("digest")


def stored_places(spark: SparkSession, source: str, build) -> DataFrame:
    """The use places of a source."""
    return get_places(spark, once(spark, "places", source, build, put_places))
