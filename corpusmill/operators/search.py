"""Name, content, comment and literal search as predicates of one declarative plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_matches(name: Column, term: str, mode: str = "substring") -> Column:
    """exact and case_insensitive ignore case, as prefix and substring do; regex is unanchored."""
    low = F.lower(name)
    if mode in ("exact", "case_insensitive"):
        return low == term.lower()
    if mode == "prefix":
        return low.startswith(term.lower())
    if mode == "substring":
        return low.contains(term.lower())
    if mode == "regex":
        return name.rlike("(?i)" + term)
    raise ValueError(f"match mode {mode}")


def content_matches(code: Column, term: str, mode: str = "substring") -> Column:
    """regex over the lower-cased text, else a substring of it; names' exact and prefix have no meaning for text."""
    return F.lower(code).rlike("(?i)" + term) if mode == "regex" else F.lower(code).contains(term.lower())


def matched_on(term: str, mode: str, full: str = "full_name", simple: str = "simple_name", raw: str = "raw_name") -> Column:
    """display if the simple or full name matches, else raw if the raw name or its last part does, else null."""
    display = name_matches(F.col(simple), term, mode) | name_matches(F.col(full), term, mode)
    hidden = name_matches(F.col(raw), term, mode) | name_matches(F.substring_index(raw, ".", -1), term, mode)
    return F.when(display, F.lit("display")).when(hidden, F.lit("raw"))


def in_package(full: Column, package: str | None) -> Column:
    """Names in a package or its subpackages; blank, defpackage and names of renamed packages (p0...) don't filter."""
    if not package or not package.strip() or package == "defpackage" or re.fullmatch(r"p\d+", package.split(".")[0]):
        return F.lit(True)
    return (full == package) | full.startswith(package + ".")


def not_excluded(full: Column, exclude: str | None) -> Column:
    """Names that begin with none of the comma-separated prefixes."""
    out = F.lit(True)
    for p in (p.strip() for p in (exclude or "").split(",")):
        if p:
            out = out & ~full.startswith(p)
    return out


def comments(code: Column) -> Column:
    """The comments of a text: what follows // on a line, and what /* */ encloses; // in strings counts."""
    return F.concat(F.regexp_extract_all(code, F.lit(r"//([^\r\n]*)"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1)))


def comment_matches(code: Column, term: str, found: Column | None = None) -> Column:
    return F.exists(comments(code) if found is None else found, lambda c: F.lower(c).contains(term.lower()))


def search(corpus: DataFrame, term: str, mode: str = "substring", package: str | None = None, exclude: str | None = None, names: bool = True, content: bool = True) -> DataFrame:
    """class_id, full_name, matched_on (display, raw or code) of the rows that match, cheap predicates first."""
    rows = corpus.where(in_package(F.col("full_name"), package) & not_excluded(F.col("full_name"), exclude))
    by_name = matched_on(term, mode) if names else F.lit(None).cast("string")
    by_code = F.when(content_matches(F.col("code"), term, mode), F.lit("code")) if content else F.lit(None).cast("string")
    return rows.select("class_id", "full_name", F.coalesce(by_name, by_code).alias("matched_on")).where("matched_on is not null")


def search_names(names: DataFrame, term: str, mode: str = "substring", kinds: tuple[str, ...] = ("class", "method", "field")) -> DataFrame:
    """name, kind: each name once, under the first of the kinds (class, method, field) that has it."""
    hit = names.where(F.col("kind").isin(*kinds) & name_matches(F.col("name"), term, mode))
    return hit.groupBy("name").agg(F.min_by("kind", "kind_rank").alias("kind"))


def indexed_names(names: DataFrame, term: str, places: tuple[str, ...] = ("class", "method", "field")) -> DataFrame | None:
    """kind, name, matched_on of the names that a name index finds: each once, under its first kind; matched_on is set for classes alone.

    None where the index can't answer: a term with a wildcard, a space or a dot, or a place that holds no names.
    """
    if not term or re.search(r"[*?\s.]", term) or not set(places) <= {"class", "method", "field"}:
        return None
    found = search_names(names, term, kinds=places)
    return found.select("kind", "name", F.when(F.col("kind") == "class", "display").alias("matched_on"))


def literals(rows: DataFrame, key: str, text: str, least: int = 8, contains: str | None = None, regex: str | None = None) -> DataFrame:
    """key, nth, literal, line: double-quoted literals of least characters or more, with the line of the opening quote.

    The lines of the pieces before a literal add up to its line: one running sum along a text, before its literals are rows.
    """
    pattern = f'"([^"\\n]{{{least},}})"'
    held = rows.where(F.col(text).rlike(pattern)).withColumn("row", F.monotonically_increasing_id())
    breaks = F.transform(F.split(text, pattern, -1), lambda g: F.length(g) - F.length(F.replace(g, F.lit("\n"), F.lit(""))))
    found = held.select("row", F.col(key), F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("literal"), breaks.alias("breaks"))).alias("i", "hit"))
    before = F.sum("hit.breaks").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    out = found.select(key, (F.col("i") + 1).alias("nth"), F.col("hit.literal").alias("literal"), (before + 1).cast("int").alias("line")).where("literal is not null")
    if contains:
        out = out.where(F.lower("literal").contains(contains.lower()))
    return out.where(F.col("literal").rlike(regex)) if regex else out
