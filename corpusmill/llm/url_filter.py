"""URL filter: rules first, then the likelihood ratio of two character models.

Two variable-order Markov models over the characters of whole URLs are counted from all URLs that a rule allows
or blocks, one model each. Characters fold to 32 symbols (letters, one for digits, ``.``, ``/``, ``-`` and
``_``, all others, start), so a model of order 3 has 32^4 entries at most, whatever the size of the corpus:
that is the proven bound of what is broadcast. Probabilities are smoothed by Witten and Bell's rule, each order
falling back on the next lower one. A URL's score is the mean over its characters of the log ratio, in whole
millionths of a nat, so that sums don't depend on their order. The threshold is the one, in steps of 0.01 nat, that
tells allowed from blocked URLs best (mean of both classes' accuracies) over all labelled URLs.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
FOLD_FROM = "abcdefghijklmnopqrstuvwxyz0123456789./-_[\\]^@"
FOLD_REST = r"[^A-Z\[\\\]\^_]"
FOLD_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ[[[[[[[[[[\\]^^_____"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SYMBOLS, ORDER = 32, 3


def host_path(url: Column) -> tuple[Column, Column]:
    host, path = (F.coalesce(F.regexp_extract(url, PARTS, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    return F.regexp_replace(F.translate(url, FOLD_FROM, FOLD_TO), FOLD_REST, "_")


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character of a URL: state, the last four symbols as a number."""
    at = urls.where("length(symbols) > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("symbols"))))
    last = F.substring(F.concat(F.lit("@" * ORDER), "symbols"), F.col("i"), F.lit(ORDER + 1))
    state = sum((F.ascii(F.substring(last, F.lit(k + 1), F.lit(1))) - 64) * SYMBOLS ** (ORDER - k) for k in range(ORDER + 1))
    return at.withColumn("state", state.cast("long"))


def model(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios in millionths: (low, v) for every gram of order 2, and (state, v) where an order-3 context was seen.

    urls: symbols, label (allow, block or null).
    """
    spark = urls.sparkSession
    is_a, is_r = (F.sum(F.when(F.col("label") == x, 1).otherwise(0)) for x in ("allow", "block"))
    counts = _grams(urls.where("label is not null")).groupBy("state").agg(is_a.alias("a"), is_r.alias("r")).checkpoint()
    lower = None
    for k in range(ORDER + 1):
        grams = counts.groupBy((F.col("state") % SYMBOLS ** (k + 1)).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        kinds = [F.sum(x).alias("n" + x) for x in "ar"] + [F.sum(F.when(F.col(x) > 0, 1).otherwise(0)).alias("t" + x) for x in "ar"]
        context = grams.groupBy(F.floor(F.col("g") / SYMBOLS).alias("c")).agg(*kinds)
        if k < ORDER:
            every = spark.range(SYMBOLS ** (k + 1)).withColumnRenamed("id", "g").withColumn("c", F.floor(F.col("g") / SYMBOLS))
            every = every.join(context, "c", "left")
        else:
            every = context.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SYMBOLS - 1).cast("long"))))
            every = every.withColumn("g", F.col("c") * SYMBOLS + F.col("g"))
        every = every.join(grams, "g", "left")
        if lower is None:
            every = every.withColumns({"qa": F.lit(1 / SYMBOLS), "qr": F.lit(1 / SYMBOLS)})
        else:
            every = every.withColumn("low", F.col("g") % SYMBOLS**k).join(lower, "low")
        p = {}
        for x in "ar":
            n, t, own = (F.coalesce(c, F.lit(0)).cast("double") for c in ("n" + x, "t" + x, x))
            p["p" + x] = F.when(n + t > 0, (own + t * F.col("q" + x)) / (n + t)).otherwise(F.col("q" + x))
        every = every.select("g", *(c.alias(name) for name, c in p.items()))
        v = F.round((F.log("pa") - F.log("pr")) * 1_000_000).cast("long").alias("v")
        if k == ORDER:
            return low, every.select(F.col("g").alias("state"), v.alias("high"))
        lower = every.select(F.col("g").alias("low"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        low = every.select(F.col("g").alias("low"), v)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log ratio in nats): one row per row of pages.

    Null URLs and URLs without ``://``: host and path are empty, no rule; the method judges the characters
    there are, and a URL without any has score 0. Ties at the threshold: allow. Repeated rows are judged alike
    and all count. Null ids stay null. Without labelled URLs of both kinds the threshold is 0. Columns other
    than id and URL are ignored. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    urls = urls.withColumns({"rule": rule, "label": verdict, "symbols": folded(F.coalesce("url", F.lit("")))})
    low, high = model(urls.select("symbols", "label"))
    # equal URLs score alike, so the distinct ones are scored
    distinct = urls.groupBy("symbols").agg(F.count("*").alias("one")).select("symbols")
    v = F.coalesce("high", "v")
    grams = _grams(distinct).withColumn("low", F.col("state") % SYMBOLS**ORDER)
    scored = grams.join(F.broadcast(high), "state", "left").join(F.broadcast(low), "low", "left")
    scored = scored.groupBy("symbols").agg((F.sum(v) / F.count("*")).alias("score")).checkpoint()
    scored = urls.join(scored, "symbols", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) / 1_000_000)
    scored = scored.withColumn("bin", F.floor(F.least(F.greatest(F.col("score"), F.lit(-20.0)), F.lit(20.0)) * 100))
    scored = scored.select("page_id", "host", "path", "rule", "label", "score", "bin")
    bins = scored.groupBy("bin").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r"))
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    kept, cut_off = (F.try_divide(F.coalesce(F.sum(x).over(below), F.lit(0)), F.sum(x).over(every)) for x in "ar")
    right = 1 - kept + cut_off
    best = bins.withColumn("right", F.round(right, 9)).where("right is not null").orderBy(F.desc("right"), F.abs("bin"), "bin").limit(1).select("bin")
    cut = F.coalesce(best.scalar(), F.lit(0))
    judged = F.coalesce("label", F.when(F.col("bin") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return url_filter(table(spark, sf_dir, "pages")).drop("score")
