"""Benchmark decontamination by greedy string tiling.

Words (letters and digits, lower case) of all benchmark items form an index of hashed seeds, runs of ``least`` words. A
document and an item that share a seed are compared: the longest common runs that touch no marked word of either
side are marked, over and over, until none of ``least`` words is left. A running Karp-Rabin hash, one polynomial sum along each
side, gives the hash of any run at any length; the length falls to the longest at which the two sides share a run, all its
matches are marked in order, and so on. If the marked words cover a given share of the item, the document is
contaminated, also when the passages stand in another order.

The index goes to the tasks in blocks of bounded size, one pass over the documents for each; the corpus itself is
never moved.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .wordhash import STEP, Words, chunks, inverse, mix, powers

#: Words of a shortest tile, and the share of an item's words that tiles must cover.
LEAST, COVER = 5, 0.6
#: Items whose index is broadcast at once: at most so many bytes of text, or one item.
INDEX_BYTES = 4 << 20


class Running:
    """Karp-Rabin hashes of the unmarked runs of a sequence of words, at any length."""

    def __init__(self, words: np.ndarray, closed: np.ndarray | None = None):
        self.words, self.marked = words, np.zeros(len(words), bool) if closed is None else closed.copy()
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words) * powers(STEP, len(words))[: len(words)], dtype=np.uint64)))
        self.back = powers(inverse(STEP), len(words) + 1)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of n words that hold no marked one."""
        seen = np.concatenate(([0], np.cumsum(self.marked)))
        start = np.flatnonzero(seen[n:] == seen[:-n]) if n <= len(self.words) else np.zeros(0, np.int64)
        return start, mix((self.total[start + n] - self.total[start]) * self.back[start])


def tiles(item, doc, least: int = LEAST, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(item start, document start, words) of each tile, longest first; ties by item start, then document start.

    item and doc: words as numbers; closed: words of doc that no tile may hold. Each length costs a few passes over both
    sides, and at a length each run is looked at once, also where a word is repeated over and over.
    """
    own, other = Running(np.asarray(item, np.uint64)), Running(np.asarray(doc, np.uint64), closed)
    out, most = [], min(len(own.words), len(other.words))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(own.runs(n)[1], other.runs(n)[1]).any() else (low, n - 1)
        if low < least:
            break
        (at, hash_), (there, near) = own.runs(low), other.runs(low)
        order = np.argsort(near, kind="stable")
        there, near = there[order], near[order]
        first, last = np.searchsorted(near, hash_, "left"), np.searchsorted(near, hash_, "right")
        following: dict[int, int] = {}
        for i, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            if a == b or own.marked[i : i + low].any():
                continue
            # what is marked stays marked, so a place that was taken is not looked at again
            k = following.get(a, a)
            while k < b and (other.marked[(j := int(there[k])) : j + low].any() or not np.array_equal(own.words[i : i + low], other.words[j : j + low])):
                k += 1
            following[a] = k
            if k < b:
                own.marked[i : i + low] = other.marked[j : j + low] = True
                out.append((i, j, low))
        most = low - 1
    return out


class Index:
    """The words and seeds of a block of items, as hashes."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.items, seeds, of = least, [], defaultdict(list), defaultdict(list)
        for item_id, text in items:
            words = Words([text.encode("utf-8", "surrogatepass")], letters=True)
            n = min(least, len(words.hash))
            if n:
                seeds[n].append(words.grams(n))
                of[n].append(np.full(len(seeds[n][-1]), len(self.items)))
                self.items.append((item_id, words.hash))
        #: by length: seeds in order, and the items that they are of
        self.seeds = {}
        for n, found in seeds.items():
            seed = np.concatenate(found)
            order = np.argsort(seed, kind="stable")
            self.seeds[n] = (seed[order], np.concatenate(of[n])[order])

    def shared(self, texts: list):
        """(index, hashes of its words, numbers of the items that share a seed) of the texts that share one."""
        for first, group in chunks(texts):
            words, near = Words(group, letters=True), defaultdict(set)
            for n, (seed, of) in self.seeds.items():
                gram = words.grams(n)
                a, b = np.searchsorted(seed, gram, "left"), np.searchsorted(seed, gram, "right")
                hit = np.flatnonzero(b > a)
                text = np.searchsorted(words.first, hit, "right") - 1
                for t, h in zip(text[hit + n <= words.first[text + 1]].tolist(), hit[hit + n <= words.first[text + 1]].tolist(), strict=True):
                    near[t].update(of[a[h] : b[h]].tolist())
            for t in sorted(near):
                yield first + t, words.hash[words.first[t] : words.first[t + 1]], sorted(near[t])

    def matches(self, texts: list, cover: float):
        """(index, item_id, share covered, tiles) of texts and the items that they contain."""
        for i, words, near in self.shared(texts):
            other = Running(words)
            for at in near:
                item_id, item = self.items[at]
                n = min(self.least, len(item))
                # only words of shared seeds can be in a tile
                (_, own), (start, there) = Running(item).runs(n), other.runs(n)
                if _covered(np.flatnonzero(np.isin(own, there)), n, len(item)).sum() < cover * len(item):
                    continue
                open_ = _covered(start[np.isin(there, own)], n, len(words))
                kept = np.flatnonzero(open_ | np.concatenate(([False], open_[:-1])))
                found = tiles(item, words[kept], n, ~open_[kept])
                share = sum(t[2] for t in found) / len(item)
                if share >= cover:
                    yield i, item_id, share, [(a, int(kept[b]), size) for a, b, size in found]


def _covered(start: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words that runs of n words from these starts cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge)[:-1] > 0


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles: a row for each row of docs and benchmark item that it contains.

    Items shorter than a seed are matched as a whole; items without words match nothing. Null or empty texts hold
    nothing. Null ids stay null; repeated documents and items give a row each. Columns other than doc_id and
    text, item_id and text are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select("item_id", "text").where("text is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long, coverage double, n_tiles long")
    for block in index_blocks(items):
        sent = spark.sparkContext.broadcast(Index(block, least))
        out = out.union(rows.mapInArrow(_matcher(sent, cover), "doc_id long, item_id long, coverage double, n_tiles long"))
    return out


def index_blocks(items: DataFrame):
    """The items in blocks of about INDEX_BYTES, read one partition at a time."""
    block, held = [], 0
    for r in items.toLocalIterator():
        size = len(r["text"])
        if block and held + size > INDEX_BYTES:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += size
    if block:
        yield block


def _matcher(sent, cover: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])

    def run(batches):
        for batch in batches:
            doc_id = batch.column("doc_id").to_pylist()
            out = [(doc_id[i], item, share, len(found)) for i, item, share, found in sent.value.matches(batch.column("text").to_pylist(), cover)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER) -> DataFrame:
    """The rows of docs that contain no benchmark item. Columns as in docs; nulls and empty texts stay."""
    prepare(docs.sparkSession)
    out = docs
    for block in index_blocks(benchmark.select("item_id", "text").where("text is not null")):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, least))

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[i for i, *_ in sent.value.matches(batch.column("text").to_pylist(), cover)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute(docs: list[tuple], items: list[tuple], least: int = LEAST, cover: float = COVER) -> set:
    """(doc_id, item_id, words covered, tiles) by plain greedy string tiling of every pair, word by word."""
    import re

    def words(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z\u00c0-\u00de]", lambda m: chr(ord(m[0]) + 32), text or ""))

    out, cut = set(), [(d, words(t)) for d, t in docs]
    for item_id, text in items:
        a = words(text)
        n = min(least, len(a))
        seeds = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} if a else set()
        for doc_id, b in cut:
            if not any(tuple(b[j : j + n]) in seeds for j in range(len(b) - n + 1)):
                continue
            free_a, free_b, tiled = [True] * len(a), [True] * len(b), 0
            while True:
                best, found = n - 1, []
                for i in range(len(a)):
                    for j in range(len(b)):
                        k = 0
                        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                            k += 1
                        if k > best:
                            best, found = k, []
                        if k == best and k >= n:
                            found.append((i, j))
                if not found:
                    break
                for i, j in found:
                    if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                        free_a[i : i + best] = free_b[j : j + best] = [False] * best
                        tiled += 1
            if free_a.count(False) >= cover * len(a):
                out.add((doc_id, item_id, free_a.count(False), tiled))
    return out
