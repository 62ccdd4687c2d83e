"""Mutable side tables as append-only logs: notes, renames, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame, key: list[str], seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The last entry of each key, without keys that it deletes."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("last"))
    out = last.select(*key, "last.*")
    return out.where(~F.col(deleted)).drop(deleted) if deleted in log.columns else out


def renamed(rows: DataFrame, log: DataFrame, name: str = "raw_name") -> DataFrame:
    """rows with alias: the new name of its last rename, else its own."""
    last = log.groupBy("key").agg(F.max_by("new_name", "seq").alias("new_name"))
    return rows.join(last, rows[name] == last["key"], "left").withColumn("alias", F.coalesce("new_name", name)).drop("key", "new_name")


def move_package(rows: DataFrame, old: str, new: str, name: str = "full_name") -> DataFrame:
    """rows with alias: names of the package and its subpackages under the new package."""
    hit = (F.col(name) == old) | F.col(name).startswith(old + ".")
    return rows.withColumn("alias", F.when(hit, F.concat(F.lit(new), F.substring(F.col(name), F.lit(len(old) + 1), F.length(name)))).otherwise(F.col(name)))


def parse_mapping(lines: DataFrame) -> DataFrame:
    """original, obfuscated: the class lines of a mapping file; members, comments and blank lines are skipped."""
    pattern = r"^([^\s#][^ ]*) -> ([^ ]+):\s*$"
    return lines.select(F.regexp_extract("line", pattern, 1).alias("original"), F.regexp_extract("line", pattern, 2).alias("obfuscated")).where("original <> ''")


def import_mapping(entries: DataFrame, known: DataFrame) -> DataFrame:
    """kind, key, new_name, status: applied, or why not."""
    valid = F.col("new_name").rlike("^[A-Za-z_$][A-Za-z0-9_$.]*$")
    found = entries.join(known.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    status = F.when(~F.col("kind").isin("class", "method", "field"), "bad kind").when(F.col("known").isNull(), "not found").when(F.col("new_name").isNull() | ~valid, "bad name").otherwise("applied")
    return found.select("kind", "key", "new_name", status.alias("status"))
