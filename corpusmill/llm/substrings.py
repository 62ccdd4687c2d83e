"""Substring dedup by relative Lempel-Ziv parsing.

Each document is factored against an index of every earlier text of the corpus. The index is cut into
reference blocks by hash, so that a document meets only the blocks that can hold its windows:

1. Seeds. Of each window of ``window`` words one word n-gram, the one of smallest hash, is its seed; equal
   windows have equal seeds. A seed that occurs once in the corpus rules out all windows that it stands for.
2. Reference blocks. The windows of repeated seeds go, by hash, to the block that indexes them; each block
   keeps the first start (smallest document, then position) of each window. Aggregation starts in the tasks
   that read the text, so a passage that a third of the corpus repeats leaves each task as one row a window.
3. Factors. In a document, each maximal run of windows that start earlier elsewhere is a factor of the parse.
   Windows across a boundary of two factors are looked up like all others, so a duplicate that a greedy
   factor would have cut in two is found as well.

The result is exact up to collisions of 64-bit hashes: a word is removed if and only if a window of the input
that covers it starts earlier too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .wordhash import Words, chunks, mix

#: Bits of a seed's hash that are kept. A collision only means that more windows are looked up.
SEED_BITS = 44


def seeds(words: Words, text: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a text: hash and position of its seeds, and for each window the position of its seed."""
    a, b = words.first[text], words.first[text + 1]
    n = b - a - window + 1
    grams = words.all_grams[a : max(a, b - gram + 1)]
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - gram + 1):
        better = grams[j : j + n] < best
        best[better] = grams[j : j + n][better]
        at[better] = j
    of = at + np.arange(n)
    new = np.concatenate(([True], of[1:] != of[:-1]))
    return best[new], of[new], of


def _texts(batch: pa.RecordBatch, window: int, gram: int):
    """(row, words, text in words) for each text with a window."""
    for first, group in chunks(batch.column("text").to_pylist()):
        words = Words(group)
        words.all_grams = words.grams(gram)
        for i in range(len(group)):
            if words.first[i + 1] - words.first[i] >= window:
                yield first + i, words, i


def _batches(columns: list[np.ndarray], schema: pa.Schema, size: int = 200_000):
    for at in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + size]) for x in columns], schema=schema)


def _seed_rows(window: int, gram: int):
    """Rows (seed, doc, place, known). A seed that a batch has more than once is known to be repeated there: one of
    its rows keeps the seed for the other tasks, the rest need no partner and get numbers that spread them."""
    schema = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("known", pa.bool_())])

    def run(batches):
        for batch in batches:
            doc, dup, out = batch.column("doc").to_numpy(), batch.column("dup").to_numpy(), []
            for row, words, i in _texts(batch, window, gram):
                h, pos, _ = seeds(words, i, window, gram)
                out.append(((h >> np.uint64(64 - SEED_BITS)).astype(np.int64), np.full(len(h), doc[row]), dup[row] + pos))
            if not out:
                continue
            seed, of, place = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(seed, kind="stable")
            follows = np.concatenate(([False], seed[order][1:] == seed[order][:-1]))
            known = np.zeros(len(seed), bool)
            known[order] = follows | np.concatenate((follows[1:], [False]))
            rest = order[follows]
            seed[rest] = -1 - (mix(of[rest].astype(np.uint64) * np.uint64(1 << 20) + place[rest].astype(np.uint64)) >> np.uint64(20)).astype(np.int64)
            yield from _batches([seed, of, place, known], schema)

    return run


def _live(words: Words, text: int, places: np.ndarray, dup: int, window: int, gram: int) -> np.ndarray:
    """The starts of a text's windows whose seed is repeated."""
    _, _, of = seeds(words, text, window, gram)
    return np.flatnonzero(np.isin(of + dup, places))


def _window_rows(window: int, gram: int):
    schema = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])

    def run(batches):
        for batch in batches:
            doc, dup, live, out, held = batch.column("doc").to_numpy(), batch.column("dup").to_numpy(), batch.column("live"), [], 0
            for row, words, i in _texts(batch, window, gram):
                start = _live(words, i, live[row].values.to_numpy(), dup[row], window, gram)
                if not hasattr(words, "windows"):
                    words.windows = words.grams(window).view(np.int64)
                out.append((words.windows[words.first[i] + start], np.full(len(start), doc[row]), dup[row] + start))
                held += len(start)
                if held > 200_000:
                    yield from _batches([np.concatenate(x) for x in zip(*out, strict=True)], schema)
                    out, held = [], 0
            if out:
                yield from _batches([np.concatenate(x) for x in zip(*out, strict=True)], schema)

    return run


def factors(duplicate: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of words (start, end) that the windows starting at these sorted positions cover."""
    if not len(duplicate):
        return []
    cut = np.flatnonzero(np.diff(duplicate) > window)
    starts = duplicate[np.concatenate(([0], cut + 1))]
    ends = duplicate[np.concatenate((cut, [len(duplicate) - 1]))] + window
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def _parse(window: int, gram: int):
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            doc, dup, copy = (batch.column(c).to_pylist() for c in ("doc", "dup", "copy"))
            live, first, text = batch.column("live"), batch.column("firsts"), batch.column("text")
            for at in range(0, len(batch), 64):
                out = []
                for row in range(at, min(at + 64, len(batch))):
                    t = text[row].as_py()
                    raw = t.encode("utf-8", "surrogatepass") if t is not None else b""
                    words, spans = raw.split(), []
                    if copy[row]:
                        spans = [(0, len(words))] if len(words) >= window else []
                    elif live[row].is_valid and len(words) >= window:
                        w = Words([raw])
                        w.all_grams = w.grams(gram)
                        start = _live(w, 0, live[row].values.to_numpy(), dup[row], window, gram)
                        own = first[row].values.to_numpy() if first[row].is_valid else np.zeros(0, np.int64)
                        spans = factors(start[~np.isin(start + dup[row], own)], window)
                    kept, done = [], 0
                    for a, b in spans:
                        kept += words[done:a]
                        done = b
                    kept += words[done:]
                    out.append((doc[row], len(words), len(words) - len(kept), [list(x) for x in spans], b" ".join(kept).decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


#: Rows without an id are numbered from here by a digest of their text, after all ids.
NO_ID = 1 << 62


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed), kept_text: one row per row of docs.

    Words are runs of characters other than space and 0x09-0x0D. A word goes if a window of ``window`` words
    that covers it also starts earlier: in a document of smaller id, or earlier in its own document.
    Null or empty texts: no words, empty kept_text. Texts shorter than a window are kept. Null ids come last, ids are
    under 2^62. Rows that repeat an id: ordered by a digest of the text, an equal text is a copy. Columns other than id and
    text are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def number(digest: Column, first: int, last: int) -> Column:
        return F.conv(F.substring(digest, first, last), 16, 10).cast("long")

    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + number(F.md5(text), 1, 15))
    base = docs.select(doc.alias("doc"), text.alias("text"))
    # One text of each group of exact copies takes part; which one, and whether its id names more texts, is known from ids and digests alone.
    ids = base.select("doc", F.unhex(F.md5("text")).alias("sig")).groupBy("doc", "sig").agg(F.count("*").alias("n")).checkpoint()
    lead = ids.groupBy("sig").agg(F.min("doc").alias("doc")).groupBy("doc").agg(F.collect_list("sig").alias("leads"))
    lead = ids.groupBy("doc").agg(F.count("*").alias("texts"), F.max("n").alias("rows")).join(lead, "doc", "left")
    # Everything below meets the texts by doc, in one job: their exchange is written once and read by each step.
    held = base.repartition("doc").join(lead, "doc").withColumn("digest", F.md5("text"))
    copy = F.col("leads").isNull() | ~F.array_contains("leads", F.unhex("digest"))
    if ids.where("n > 1").limit(1).count():
        copy = copy | (F.row_number().over(Window.partitionBy("doc", "digest").orderBy(F.lit(1))) > 1)
    dup = F.when(F.col("texts") > 1, F.shiftleft(number(F.col("digest"), 1, 7), 32)).otherwise(F.lit(0).cast("long"))
    held = held.select("doc", dup.alias("dup"), copy.alias("copy"), "text")
    leads = held.where("not copy").select("doc", "dup", "text")

    found = leads.mapInArrow(_seed_rows(window, gram), "seed long, doc long, place long, known boolean")
    found = found.withColumn("n", F.count("*").over(Window.partitionBy("seed"))).where("known or n > 1")
    live = found.groupBy("doc").agg(F.collect_list("place").alias("live"))

    windows = leads.join(live, "doc").mapInArrow(_window_rows(window, gram), "hash long, doc long, place long")
    firsts = windows.groupBy("hash").agg(F.min(F.struct("doc", "place")).alias("at"))
    firsts = firsts.select("at.*").groupBy("doc").agg(F.collect_list("place").alias("firsts"))

    parsed = held.join(live, "doc", "left").join(firsts, "doc", "left")
    parsed = parsed.mapInArrow(_parse(window, gram), "doc long, n_words long, n_removed long, spans array<array<int>>, kept_text string")
    return parsed.select(F.when(F.col("doc") < NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "spans", "kept_text")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple], window: int = 20) -> dict:
    """doc_id: (n_words, n_removed, kept_sha256) for (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out
