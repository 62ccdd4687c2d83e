"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. A HyperLogLog sketch of the sites of each line hash is merged by
aggregation, in the tasks that cut the texts first; lines whose estimate is near the threshold get an exact
distinct count of sites, each site of a line counted once before it moves. Lines are cut once and written as narrow rows.

Lines that hold more than a thousandth of all occurrences are a thousand at most: these are broadcast, so no line, however
frequent, meets its occurrences in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Distinct sites from which on a line is boilerplate, and the sketch's size (standard error 1.04 / 2^(LG_K/2)).
MIN_SITES, LG_K = 8, 11
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 5
BLANKS = " \t\n\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


#: A line with more than one in so many occurrences is looked up in each task.
HOT = 1000


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """hash, length, n (occurrences on sites) of the lines on min_sites sites or more. lines: hash, length, site (null: no site)."""
    error = ERRORS * 1.04 / 2 ** (lg_k / 2)
    placed = lines.where("site is not null")
    sketched = placed.groupBy("hash", "length").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    # a line needs as many occurrences as sites
    sketched = sketched.where(F.col("n") >= min_sites).select("hash", "length", "n", F.hll_sketch_estimate("sketch").alias("sites")).checkpoint()
    sure = sketched.where(F.col("sites") > min_sites * (1 + error)).select("hash", "length", "n")
    near = sketched.where((F.col("sites") <= min_sites * (1 + error)) & (F.col("sites") >= min_sites * (1 - error)))
    each = placed.groupBy("hash", "length", "site").agg(F.lit(1).alias("one"))
    exact = near.select("hash", "length", "n").join(each, ["hash", "length"]).groupBy("hash", "length", "n").agg(F.count("*").alias("sites"))
    return sure.union(exact.where(F.col("sites") >= min_sites).select("hash", "length", "n"))


def occurrences(each: DataFrame, common: DataFrame, total: int) -> DataFrame:
    """The rows of each whose line is common (hash, length, n); total: rows of each."""
    hot = common.where(F.col("n") * HOT > total).select("hash", "length", F.lit(True).alias("hot"))
    known = each.join(F.broadcast(hot), ["hash", "length"], "left")
    rest = common.where(F.col("n") * HOT <= total).select("hash", "length")
    return known.where("hot").drop("hot").unionByName(known.where("hot is null").drop("hot").join(rest, ["hash", "length"]))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_texts: int = 0) -> DataFrame:
    """The rows of docs with n_lines, n_removed and kept_text (the lines that stay, joined by \\n); other columns stay.

    Lines end at \\n and are compared without the white space around them; blank lines are never removed. Null
    texts: 0 lines, kept_text null; empty texts have one blank line. A null site is no site. Repeated rows are
    all cleaned and add no site. Lines on many sites that stand in fewer than min_texts distinct texts stay: exact
    copies of a document count once there, so what was only copied is no boilerplate. Null ids are kept. Columns of docs named like a result column are replaced. An
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept_text")]
    # rows are told apart by a digest, so that ids may repeat or be null
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit("")))))
    # names of this operator, so that those of docs cannot clash with them
    base = docs.select(*(F.col(c).alias(f"k_{c}") for c in names), key.alias("row"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    each = base.select("row", "site", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    each = each.withColumn("line", trimmed(F.col("raw"))).where("line <> ''")
    each = each.select("row", "pos", F.xxhash64("line").alias("hash"), F.octet_length("line").alias("length"), "site", "body").checkpoint()
    common, total = boilerplate(each, min_sites).checkpoint(), each.count()
    found = occurrences(each, common, total)
    if min_texts > 1:
        found = found.checkpoint()
        bodies = found.where("site is not null").groupBy("hash", "length", "body").agg(F.lit(1).alias("one"))
        texts = bodies.groupBy("hash", "length").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
        found = occurrences(found, common.join(texts.select("hash", "length"), ["hash", "length"], "left_semi").checkpoint(), total)
    gone = found.groupBy("row").agg(F.collect_set("pos").alias("gone"))
    own = base.join(gone, "row", "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return own.select(*(F.col(f"k_{c}").alias(c) for c in names), count.alias("n_lines"), removed.alias("n_removed"), kept.alias("kept_text"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
