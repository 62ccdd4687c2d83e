"""Cross references with positions, lines and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(corpus: DataFrame) -> DataFrame:
    """class_id, line_no (from 1), line."""
    return corpus.where("code is not null").select("class_id", F.posexplode(F.split("code", "\n", -1)).alias("i", "line")).select("class_id", (F.col("i") + 1).alias("line_no"), "line")


def snippet(text: Column, line: Column, around: int = 2) -> Column:
    """A line and the lines around it, as one text."""
    all_lines = F.split(text, "\n", -1)
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(all_lines, first, line + around - first + 1), "\n")


def whole_word(text: Column, word: Column) -> Column:
    """How often a word stands in a text between characters that are no letters, digits or _; $ ends a word.

    A separator doubled between neighbours lets one pass find words that share it.
    """
    parts = F.split(text, "[^\\p{L}\\p{Nd}_]", -1)
    return F.size(F.filter(parts, lambda p: p == word))


def occurrences(edge: DataFrame, corpus: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, class_id, line_no, n: lines of a referrer's text that name a target; 0, 0 where none does.

    edge: class_id (referrer), target_id; targets: target_id, word. Import lines don't count. Each text is cut into
    words once, and its words meet the targets by an equi-join.
    """
    text = lines(corpus.join(edge.select("class_id").distinct(), "class_id", "left_semi")).where(~F.trim("line").startswith("import "))
    words = text.select("class_id", "line_no", F.explode(F.split("line", "[^\\p{L}\\p{Nd}_]", -1)).alias("word")).where("word <> ''")
    wanted = edge.join(targets, "target_id")
    hit = words.join(wanted, ["class_id", "word"]).groupBy("target_id", "class_id", "line_no").agg(F.count("*").alias("n"))
    rest = edge.join(hit.select("class_id", "target_id").distinct(), ["class_id", "target_id"], "left_anti")
    return hit.unionByName(rest.select("target_id", "class_id", F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("n")))


def enclosing(queries: DataFrame, marks: DataFrame) -> DataFrame:
    """as-of: for each query (class_id, pos) the last mark (class_id, at, ref) at or before it, as ref.

    Both are lined up by position in one window for each class, so no pair of a query and a mark is built.
    """
    both = queries.select("class_id", F.col("pos").alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("ref")).union(marks.select("class_id", F.col("at").alias("p"), F.lit(0).alias("kind"), "ref"))
    order = Window.partitionBy("class_id").orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("ref", F.last("ref", ignorenulls=True).over(order)).where("kind = 1").select("class_id", F.col("p").alias("pos"), "ref")


def merged(*refs: DataFrame) -> DataFrame:
    """References (class, method, line, snippet) of several ways to find them, each once."""
    out = refs[0]
    for r in refs[1:]:
        out = out.unionByName(r)
    key = ["class", "method", "line", "snippet"]
    return out.fillna("", ["class", "method", "snippet"]).fillna(0, ["line"]).dropDuplicates(key)


def missing(cheap: DataFrame, indexed: DataFrame) -> DataFrame:
    """Referrers (src, dst) that an index lacks; it may answer only if there are none."""
    return cheap.join(indexed, ["src", "dst"], "left_anti")


def gated(cheap: DataFrame, levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """src, dst, way: the referrers of each target from the first of the levels that lacks none of the cheap ones, else these, as live.

    cheap and the levels: src, dst. Coverage is judged for each target by itself.
    """
    choice = cheap.select("dst").distinct()
    for name, rows in levels:
        gaps = missing(cheap, rows).select("dst").distinct().withColumn(f"_{name}", F.lit(True))
        choice = choice.join(gaps, "dst", "left")
    way = F.coalesce(*(F.when(F.col(f"_{name}").isNull(), name) for name, _ in levels), F.lit("live"))
    choice = choice.select("dst", way.alias("way"))
    out = None
    for name, rows in [*levels, ("live", cheap)]:
        own = rows.join(choice.where(F.col("way") == name), "dst").select("src", "dst", "way")
        out = own if out is None else out.unionByName(own)
    return out


#: Fixed value: requests of a batch.
BATCH = 10


def batch(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, item, status, n, first: a batch of requests (ord, item), each with a status of its own.

    An item is class:name, or method:class:member or field:class:member. Status: bad request, too many (from the
    eleventh on), not found, ok; n: referrers, first: the smallest.
    """
    parts = F.split("item", ":", -1)
    kind, size = F.get(parts, F.lit(0)), F.size(parts)
    fits = ((kind == "class") & (size == 2)) | (kind.isin("method", "field") & (size == 3))
    asked = asked.withColumn("target", F.when(fits & (F.col("ord") < BATCH), F.element_at(parts, -1)))
    wanted = asked.where("target is not null").select(F.col("target").alias("dst")).distinct()
    known = edges.join(wanted, "dst", "left_semi").groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n"), F.min("src").alias("first"))
    status = F.when(F.col("ord") >= BATCH, "too many").when(F.col("target").isNull(), "bad request").when(F.col("n").isNull(), "not found").otherwise("ok")
    return asked.join(known, "target", "left").select("ord", "item", status.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first")
