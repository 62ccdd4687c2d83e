"""Secret scan with corpus-wide ownership frequency.

Three base patterns give candidates in every text. Further opaque tokens are candidates too; they and the base
hits are hashed, and for each hash the distinct repositories and owners of the whole corpus are counted. What many
repositories share is an example copied from documentation; what stays with one owner looks like a live
credential. An opaque token becomes a span only if it looks live; base spans always stay.

A text is cut once for each kind, into the lengths between and of its hits; running sums along a text give positions, and
running extremes the overlaps, so the work grows with the length of a text, however many hits it holds. Values that make up
more than a thousandth of all hits are a thousand at most; these are broadcast, so no copied example meets all its places
in one task.

DataFrame functions only. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Kind, pattern, group of the value, least length of the value. For access and hex the least
#: length is in the pattern: a run of that length starts where the longest run does.
KINDS = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24),
]
#: A value in more repositories than this, or of more owners, is an example.
MAX_REPOS, MAX_OWNERS = 2, 2

#: A value with more than one in so many hits is looked up in each task.
HOT = 1000
#: Runs of so many small letters make words of a token: it names something.
NAMED = "[a-z]{6}"
HIT = "array<struct<start:int,kind:int,end:int,value:string>>"
PIECE = "array<struct<gap:int,size:int,value:string>>"


def pieces(text: Column, pattern: str, group: int) -> Column:
    """The matches of a pattern, leftmost first and non-overlapping: characters since the one before, own characters, value."""
    gaps, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    every = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value"))
    # the piece after the last match has no match
    return F.when(text.rlike(pattern), F.slice(every, 1, F.size(every) - 1).cast(PIECE)).otherwise(F.array().cast(PIECE))


def hits(found: DataFrame) -> DataFrame:
    """row, start, kind, end, value of the matches that count; found: row and a column of pieces for each kind."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(least).alias("least"), F.col(k).alias("pieces")) for i, (k, _, _, least) in enumerate(KINDS)))
    each = found.select("row", F.explode(kinds).alias("k")).select("row", "k.kind", "k.least", F.posexplode("k.pieces").alias("i", "p"))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("p.gap") + F.col("p.size")).over(before), F.lit(0)) + F.col("p.gap")
    each = each.withColumn("start", start.cast("int")).where(F.length("p.value") >= F.col("least"))
    each = each.select("row", "start", "kind", (F.col("start") + F.col("p.size")).cast("int").alias("end"), F.col("p.value").alias("value"))
    opaque, value = F.col("kind") == len(KINDS) - 1, F.col("value")
    each = each.where(~opaque | (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(NAMED)))
    # a base hit that starts at or before an opaque one may reach into it, the next one after it may start inside it
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("reach", F.max(F.when(~opaque, F.col("end"))).over(up)).withColumn("next", F.min(F.when(~opaque, F.col("start"))).over(down))
    over = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return each.where(~opaque | ~over).drop("reach", "next")


def written(spans: Column) -> Column:
    """kind:start:end by start and kind, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda h: F.concat_ws(":", F.get(names, h["kind"]), h["start"], h["end"])), ",")


def secret_scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example: one row per row of docs.

    repo and owner say whose a row is (default: the column source for both). Null texts are empty: no spans, the digest is that of the empty
    string. A null repo or owner is one unknown repo or owner. Repeated rows each get their result and count as
    one repo and owner. Null ids are kept. Other columns are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    repo, owner = (F.coalesce((F.col("source") if c is None else c).cast("string"), F.lit("")) for c in (repo, owner))
    text = F.coalesce(F.col("t"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), repo.alias("repo"), owner.alias("owner"))
    # without the texts this is small; the row numbers must not change
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", *(pieces(text, p, g).alias(k) for k, p, g, _ in KINDS)).checkpoint()
    each = hits(found.where(" or ".join(f"size({k}) > 0" for k, *_ in KINDS))).join(found.select("row", "repo", "owner"), "row")
    each = each.withColumn("hash", F.unhex(F.md5("value"))).checkpoint()
    spread = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    spread = spread.groupBy("hash").agg(F.sum("n").alias("n"), F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    live = (F.col("repos") <= MAX_REPOS) & (F.col("owners") <= MAX_OWNERS)
    spread, total = spread.select("hash", "n", live.alias("live")).checkpoint(), each.count()
    known = each.join(F.broadcast(spread.where(F.col("n") * HOT > total).select("hash", "live")), "hash", "left")
    rest = known.where("live is null").drop("live").join(spread.where(F.col("n") * HOT <= total).select("hash", "live"), "hash")
    opaque, hit = F.col("kind") == len(KINDS) - 1, F.struct("start", "kind", "end", "value")
    judged = known.where("live is not null").unionByName(rest).groupBy("row").agg(
        F.collect_list(F.when(~opaque, hit)).alias("base"),
        F.collect_list(F.when(opaque & F.col("live"), hit)).alias("added"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS[:-1])),
    )
    out = found.select("row", "doc_id").join(judged, "row", "left")
    base, added = (F.coalesce(c, F.array().cast(HIT)) for c in ("base", "added"))
    counts = {n: F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_assign", "n_access", "n_hex", "n_live", "n_example")}
    return out.select(
        "doc_id", counts["n_assign"], counts["n_access"], counts["n_hex"], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.concat(base, added)).alias("spans"), counts["n_live"], counts["n_example"],
    )


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Each source is a repository; a language stands for the owner, as documents name none."""
    from .common import table

    return secret_scan(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))
