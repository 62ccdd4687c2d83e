"""Trigram index: postings, coverage, sound pruning and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates above which a term is broad, candidates of a broad term that are verified, rows scanned.
BROAD, SAMPLE, BUDGET = 3_000, 300, 20_000


def trigrams_of(term: str) -> list[str]:
    """The trigrams of a lower-cased term that an index has: not those of blanks and control characters alone."""
    term = term.lower()
    return sorted({term[i : i + 3] for i in range(len(term) - 2) if any(c > " " for c in term[i : i + 3])})


def postings(corpus: DataFrame) -> DataFrame:
    """trigram, class_id: each trigram of each lower-cased text once.

    The index build touches every character, so each Arrow batch is cut into trigrams by Python's sets; a text
    leaves its task as distinct trigrams.
    """
    import pyarrow as pa

    schema = pa.schema([("class_id", pa.int64()), ("grams", pa.list_(pa.string()))])

    def distinct(text: str) -> list[str]:
        return [g for g in {text[i : i + 3] for i in range(len(text) - 2)} if g[0] > " " or g[1] > " " or g[2] > " "]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([distinct(t) for t in part.column(1).to_pylist()], schema.field(1).type)], schema=schema)

    rows = corpus.where("code is not null").select(F.col("class_id").cast("long").alias("class_id"), F.lower("code").alias("code"))
    return rows.mapInArrow(run, "class_id long, grams array<string>").select(F.explode("grams").alias("trigram"), "class_id")


def coverage(corpus: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """class_id, state: covered, excluded (fewer than 3 characters), hole (no text) or tombstoned."""
    size = F.length("code")
    state = F.when(F.col("code").isNull(), "hole").when(size < 3, "excluded").otherwise("covered")
    out = corpus.select("class_id", state.alias("state"))
    if tombstones is None:
        return out
    dead = tombstones.select("class_id", F.lit(True).alias("dead")).distinct()
    return out.join(dead, "class_id", "left").select("class_id", F.when(F.col("dead"), "tombstoned").otherwise(F.col("state")).alias("state"))


def candidates(index: DataFrame, covered: DataFrame, term: str) -> DataFrame:
    """class_id of the covered rows whose trigrams hold all of the term's; none for terms under 3 characters, all covered
    rows for blank ones."""
    if len(term) < 3:
        return covered.select("class_id").limit(0)
    grams = trigrams_of(term)
    live = covered.where("state = 'covered'").select("class_id")
    if not grams:
        return live
    hit = index.where(F.col("trigram").isin(grams)).groupBy("class_id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams))
    return hit.select("class_id").join(live, "class_id", "left_semi")


def lookup_state(index: DataFrame, term: str) -> DataFrame:
    """state, n: whether an index narrows a term (candidates), has none (empty) or lacks a trigram (cannot_narrow)."""
    grams = trigrams_of(term)
    hit = index.where(F.col("trigram").isin(grams)).groupBy("class_id").agg(F.count_distinct("trigram").alias("n"))
    seen = index.where(F.col("trigram").isin(grams)).agg(F.count_distinct("trigram").alias("seen"))
    total = hit.agg(F.count_if(F.col("n") == len(grams)).alias("n"))
    state = F.when(F.col("seen") < len(grams), "cannot_narrow").when(F.col("n") == 0, "empty").otherwise("candidates")
    return total.withColumn("seen", seen.scalar()).select(state.alias("state"), "n")


def verdicts(states: DataFrame, candidate: DataFrame, term: str) -> DataFrame:
    """class_id, verdict: absent only where that is certain, candidate, or scan.

    Excluded rows are too short for terms of 3 characters or more; for shorter terms they are scanned.
    """
    marked = states.join(candidate.select("class_id", F.lit(True).alias("hit")), "class_id", "left")
    long = len(term) >= 3
    sure = F.when(F.col("hit"), "candidate").when(F.col("state").isin(*(["covered", "excluded"] if long else [])), "absent") if long else F.when(F.col("hit"), "candidate")
    return marked.select("class_id", F.when(F.col("state") == "tombstoned", "scan").otherwise(F.coalesce(sure, F.lit("scan"))).alias("verdict"))


def verified(corpus: DataFrame, index: DataFrame, states: DataFrame, term: str) -> DataFrame:
    """class_id, full_name of the rows whose text holds the term: rows the index cannot rule out, then checked."""
    open_ = verdicts(states, candidates(index, states, term), term).where("verdict <> 'absent'").select("class_id")
    return corpus.join(open_, "class_id", "left_semi").where(F.lower("code").contains(term.lower())).select("class_id", "full_name")


def first_verified(corpus: DataFrame, candidate: DataFrame, term: str, broad: int = BROAD, sample: int = SAMPLE) -> DataFrame:
    """class_id, partial: verified rows; of a broad term's candidates only the first ``sample`` by id are looked at."""
    n = candidate.agg(F.count("*")).scalar()
    first = candidate.select("class_id").orderBy("class_id").limit(sample).withColumn("first", F.lit(True))
    marked = candidate.select("class_id", (n > broad).alias("partial")).join(first, "class_id", "left")
    looked = marked.where(~F.col("partial") | F.col("first")).select("class_id", "partial")
    return corpus.where(F.lower("code").contains(term.lower())).join(looked, "class_id").select("class_id", "partial")


def scanned(states: DataFrame, candidate: DataFrame, term: str, budget: int = BUDGET) -> DataFrame:
    """class_id, is_candidate of the rows that a scan budget reaches: candidates first, then the rest, by id."""
    rows = verdicts(states, candidate, term).where("verdict <> 'absent'").select("class_id", (F.col("verdict") == "candidate").alias("is_candidate"))
    return rows.orderBy(F.desc("is_candidate"), "class_id").limit(budget)


def admitted(states: DataFrame, most: int) -> DataFrame:
    """unindexed, admitted: whether a content search may run without an index over the rows that none covers."""
    n = F.count_if(F.col("state") != "covered")
    return states.agg(n.alias("unindexed"), (n <= most).alias("admitted"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0).cast("long")
