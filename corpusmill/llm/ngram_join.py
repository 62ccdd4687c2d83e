"""Exact word-shingle Jaccard join by recursive Voronoi regions.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of word shingles. Jaccard distance is
a metric, but unrelated documents all lie at distance 1 of each other, so regions around arbitrary pivots would
hold the whole corpus. The join therefore works in levels, each lossless:

1. Families. Linked documents differ in at most ``(100 - p) / (100 + p) * (|A| + |B|)`` shingles. Shingles are
   dealt, by hash, to one class more than that; so a linked pair agrees on all shingles of some class. Documents
   that agree on a class are joined to a star, and the connected stars are families; a sixteenth of the keys builds first
   families, the others are dealt to a few passes over the texts, and only keys that more than one of the families so far
   share are looked at. Sizes are cut into ranges; documents near the upper end of a range also take part in the next one (the triangle inequality with the
   empty set bounds the sizes of linked documents).
2. Voronoi regions. A family that is too large for one task is dealt to the regions of a few pivot documents;
   a document also goes to each region whose pivot is at most 2 * eps further than the nearest one. By the
   triangle inequality any link has both ends in a common region. Regions that are still too large are joined
   block by block, each pair of blocks in a task of its own.
3. Within a task, regions are split around pivots in the same way until they are small, and joined exactly on an
   inverted index. A document is compared with all others of its region unless it is in the region's largest
   component already, so no link between components can be missed.

Exact up to collisions of 64-bit shingle hashes. Only spanning links leave a task, never all pairs of a group.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, prepare, release
from .wordhash import STEP, Words, chunks, mix, powers

#: The most documents, and bytes of text, of a block; a task holds two blocks at most.
BLOCK_DOCS, BLOCK_BYTES = 1000, 2 << 20
PIVOTS, LEAF = 8, 64
#: Documents whose keys are sorted at once.
PART = 1000
#: One in so many keys builds the first families.
FIRST = 16
#: Bytes of text whose other keys are looked at in one pass; one pass at most for so many percent of distance, as keys grow with it and each pass reads all texts.
PASS_BYTES, PASS_PERCENT = 128 << 20, 5
#: Rows of three numbers that are broadcast at most.
BROADCAST = 500_000
#: Rows of keys that take their points along at once; in so many parts at most, as each reads all points.
PART_ROWS, KEY_PARTS = 1_000_000, 16
#: Bits of a finer point, and points of a block of them.
FINE_BITS, BLOCK_POINTS = 4096, 2000
#: The most bits of a point of stars; sets of more than half as many shingles are told apart less well.
MOST_BITS = 16_384
POINT = np.array([3, 5, 7, 11], np.uint64)
#: What a text with words holds.
WORD = r"[^\x20\x09-\x0D]"
_RANGES = [1]
while _RANGES[-1] < 1 << 40:
    _RANGES.append(max(_RANGES[-1] + 1, -(-_RANGES[-1] * 3 // 2)))
RANGES = np.array(_RANGES)


def shingles(words: Words, text: int, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; of all its words, if there are fewer."""
    a, b = words.first[text], words.first[text + 1]
    if b - a >= n:
        return np.unique(words.all_grams[a : b - n + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    whole = (words.hash[a:b] * powers(STEP, n)[: b - a]).sum(dtype=np.uint64)
    return mix(np.array([whole ^ np.uint64(0xA5A5 + int(b - a))]))


def _sets(texts: list, n: int):
    """(index, shingles) of each text."""
    for first, group in chunks(texts):
        words = Words(group, lower=True)
        words.all_grams = words.grams(n)
        for i in range(len(group)):
            yield first + i, shingles(words, i, n)


def class_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The keys that a set shares with every set it links with, one at least.

    A class without shingles says little. There are some classes to spare, so a set with few empty ones still shares
    a class with shingles; sets with more are also dealt by another hash, and after three hashes empty classes
    count as well.
    """
    own = int(np.searchsorted(RANGES, len(s), "right")) - 1
    out = []
    for r in [own, own + 1] if 100 * len(s) >= percent * RANGES[own + 1] else [own]:
        needed = (100 - percent) * 2 * (int(RANGES[r + 1]) - 1) // (100 + percent) + 1
        spare = needed // 12
        classes = needed + spare
        for salt in range(3):
            of = mix(s ^ np.uint64(0x51ED + 7919 * r + 104729 * salt))
            at = ((of >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, total = at[order], np.cumsum(mix(of[order]), dtype=np.uint64)
            last = np.flatnonzero(np.concatenate((at[1:] != at[:-1], [True])))
            total = total[last]
            total[1:] -= total[:-1].copy()
            out.append(mix(total ^ mix((at[last] + 1).astype(np.uint64) * np.uint64(2 * r + 3) + np.uint64(salt))))
            if len(last) >= needed:
                break
        else:
            empty = np.setdiff1d(np.arange(classes), at[last])
            out.append(mix(mix((empty + 1).astype(np.uint64) * np.uint64(2 * r + 3) + np.uint64(3))))
    return np.concatenate(out)


def parities(s: np.ndarray, bits: int = 256) -> np.ndarray:
    """For each of some hash classes whether a set has an odd number of shingles in it, as 64-bit numbers.

    Two sets differ in as many shingles, at least, as their parities do in bits.
    """
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sized_bits(size: int) -> int:
    """Bits of the parities of a set: a power of two, two for each shingle at least, so that sets which share little also look far apart.

    Fewer bits than shingles would put any two sets within the distance of a link. One range of sizes has one number of bits.
    """
    most = int(RANGES[int(np.searchsorted(RANGES, size, "right"))])
    return min(MOST_BITS, max(256, 1 << (2 * most - 1).bit_length()))


def folded(point: np.ndarray, words: int) -> np.ndarray:
    """The same parities in so many 64-bit numbers, a power of two: a class of fewer bits is the union of several."""
    return np.bitwise_xor.reduce(point.reshape(-1, words), 0) if len(point) > words else point


def _pass_of(key: np.ndarray, passes: int) -> np.ndarray:
    """The pass that looks at a key: 0 for one in FIRST, 1 to passes for the others."""
    return np.where(key % FIRST == 0, 0, 1 + key // FIRST % passes)


def _key_rows(n: int, percent: int, at_pass: int = 0, passes: int = 1):
    """Rows (key, doc, pivot) of the keys of a pass. Documents of a part of a batch that agree on a key and on their parities are one point of the region:
    the smallest keeps the key, the others come as links to it (pivot). So copies leave a part as one row a key."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("pivot", pa.int64())])

    def run(batches):
        # parts of bounded size: what is sorted at once is some hundred keys for each document
        for batch in (whole.slice(at, PART) for whole in batches for at in range(0, len(whole), PART)):
            doc, keys, docs, points = batch.column("doc").to_numpy(), [], [], []
            for i, s in _sets(batch.column("text").to_pylist(), n):
                if len(s):
                    key = (class_keys(s, percent) >> np.uint64(20)).astype(np.int64)
                    keys.append(key[_pass_of(key, passes) == at_pass])
                    docs.append(np.full(len(keys[-1]), doc[i]))
                    point = parities(s)
                    points.append(np.full(len(keys[-1]), mix(np.array([(mix(point) * POINT).sum(dtype=np.uint64)]))[0]))
            if not any(map(len, keys)):
                continue
            key, of, point = np.concatenate(keys), np.concatenate(docs), np.concatenate(points)
            order = np.lexsort((of, point, key))
            key, of, point = key[order], of[order], point[order]
            head = np.concatenate(([True], (key[1:] != key[:-1]) | (point[1:] != point[:-1])))
            lead = of[np.flatnonzero(head)[np.cumsum(head) - 1]]
            local = np.unique(np.stack((of, lead), 1)[of != lead], axis=0)
            for at in range(0, int(head.sum()), 200_000):
                k, d = key[head][at : at + 200_000], of[head][at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.nulls(len(k), pa.int64())], schema=schema)
            if len(local):
                spread = -1 - (mix(local[:, 0].astype(np.uint64)) >> np.uint64(20)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(local[:, 0]), pa.array(local[:, 1])], schema=schema)

    return run


def _points(n: int):
    schema = pa.schema([("doc", pa.int64()), ("n_shingles", pa.int64()), ("point", pa.binary())])

    def run(batches):
        for batch in batches:
            found = [(len(s), parities(s, sized_bits(len(s))).tobytes()) for _, s in _sets(batch.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return run


def _leaders(percent: int):
    """For rows (key, doc, known, n_shingles, point) sorted by key and size: links (a, b) that connect all linked documents of a key.

    known: a document that this one is in a family with already, itself at least; links are between these.

    Points have bits by their size and are compared at those of the key's smallest set.
    Regions around leaders, in the metric of parities: linked points are at most eps apart, eps for the size at hand. A
    point with no leader within eps leads a region itself, any other belongs to its nearest leader's; it is joined with all leaders
    within eps and their region's radius so far, so by the triangle inequality also with the leader of any document before it that
    it links with. A region without other points has no radius: what only shares some keys stays apart.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] = root.setdefault(up, up)
            x = root[x]
        return x

    def run(batches):
        root.clear()
        last, count, words = None, 0, 4
        leaders, led, radius = np.zeros((16, words), np.uint64), np.zeros(16, np.int64), np.zeros(16, np.int64)
        for batch in batches:
            key, doc, size = (batch.column(c).to_numpy() for c in ("key", "known", "n_shingles"))
            points = batch.column("point").to_pylist()
            eps = (100 - percent) * (size + size * 100 // percent) // (100 + percent) + 1
            a, b = [], []
            for i in range(len(key)):
                point = np.frombuffer(points[i], np.uint64)
                if key[i] != last:
                    # the first set of a key is its smallest and has the fewest bits
                    last, count = key[i], 0
                    if len(point) != words:
                        words = len(point)
                        leaders, led, radius = np.zeros((16, words), np.uint64), np.zeros(16, np.int64), np.zeros(16, np.int64)
                point = folded(point, words)
                apart = np.bitwise_count(leaders[:count] ^ point).sum(1)
                near = np.flatnonzero(apart <= eps[i] + radius[:count])
                # only links that join what this task hasn't joined
                for other in led[near].tolist():
                    x, y = find(int(doc[i])), find(other)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(int(doc[i]))
                        b.append(other)
                own = int(apart.argmin()) if count else 0
                if count and apart[own] <= eps[i]:
                    radius[own] = max(radius[own], apart[own])
                else:
                    if count == len(led):
                        leaders, led, radius = (np.concatenate((x, x)) for x in (leaders, led, radius))
                    leaders[count], led[count], radius[count], count = point, doc[i], 0, count + 1
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


class Region:
    """The sets of one task's region, as an inverted index, and what is known of their components."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size, self.percent = np.array([len(s) for s in sets]), percent
        of = np.repeat(np.arange(len(sets)), self.size)
        _, term, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[term] > 1
        self.term, self.of = term[shared], of[shared]
        self.ptr = np.concatenate(([0], np.cumsum(np.bincount(self.of, minlength=len(sets)))))
        self.posting = self.of[np.argsort(self.term, kind="stable")]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(self.term, minlength=len(df)))))
        self.root = np.arange(len(sets))

    def shared(self, i: int) -> np.ndarray:
        """The number of shingles that i shares with each set."""
        t = self.term[self.ptr[i] : self.ptr[i + 1]]
        start, count = self.at[t], self.at[t + 1] - self.at[t]
        total = int(count.sum())
        where = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total) if total else np.zeros(0, int)
        got = np.bincount(self.posting[where], minlength=len(self.size))
        got[i] = self.size[i]
        return got

    def probe(self, i: int) -> np.ndarray:
        """Join i with all that it links with; its distance to each set."""
        got = self.shared(i)
        union = self.size + self.size[i] - got
        roots = np.unique(self.root[100 * got >= self.percent * union])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return 1 - got / union

    def join(self, own: np.ndarray) -> None:
        eps = 1 - self.percent / 100
        if len(own) > LEAF:
            pivots = own[np.linspace(0, len(own) - 1, PIVOTS).astype(int)]
            far = np.stack([self.probe(p)[own] for p in pivots])
            inside = far <= far.min(0) + 2 * eps + 1e-9
            if inside.sum(1).max() < 0.8 * len(own) and inside.sum() < 3 * len(own):
                for cell in inside:
                    if cell.any():
                        self.join(own[cell])
                return
        labels, count = np.unique(self.root[own], return_counts=True)
        if len(labels) > 1:
            for i in own[self.root[own] != labels[count.argmax()]]:
                self.probe(i)


def _regions(n: int, percent: int):
    """For rows sorted by region: (a, b) for each document a and the smallest one of its component in the region.

    In a region of a large family only the rows marked as probes are compared with all others.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(docs: list[int], probes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        doc = np.array(docs)
        region = Region(sets, percent)
        if probes[0] is None:
            region.join(np.arange(len(docs)))
        else:
            for i in np.flatnonzero(probes):
                region.probe(i)
        smallest = np.full(len(docs), np.iinfo(np.int64).max)
        np.minimum.at(smallest, region.root, doc)
        found = smallest[region.root]
        return pa.RecordBatch.from_arrays([pa.array(doc[doc != found], pa.int64()), pa.array(found[doc != found], pa.int64())], schema=schema)

    def run(batches):
        last, held = None, ([], [], [])
        for batch in batches:
            doc, probe = batch.column("doc").to_pylist(), batch.column("probe").to_pylist()
            keys = list(zip(batch.column("family").to_pylist(), batch.column("region").to_pylist(), strict=True))
            for i, s in _sets(batch.column("text").to_pylist(), n):
                if keys[i] != last:
                    if len(held[0]) > 1:
                        yield solve(*held)
                    last, held = keys[i], ([], [], [])
                if len(s):
                    for column, value in zip(held, (doc[i], probe[i], s), strict=True):
                        column.append(value)
        if len(held[0]) > 1:
            yield solve(*held)

    return run


def _cells(n: int, percent: int):
    """For rows sorted by family and block, pivots (slot 0 and more) before members (slot -1): the cells of each member.

    nearest: the pivot of its Voronoi region; cells: those whose regions can hold documents that it links with;
    near: the pivots that it links with.
    """
    eps = 1 - percent / 100
    kind = pa.list_(pa.int64())
    schema = pa.schema([("family", pa.int64()), ("doc", pa.int64()), ("nearest", pa.int64()), ("cells", kind), ("near", kind)])

    def run(batches):
        known, pivots = None, {}
        for batch in batches:
            slot, doc, out = batch.column("slot").to_pylist(), batch.column("doc").to_pylist(), []
            keys = list(zip(batch.column("family").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            for i, s in _sets(batch.column("text").to_pylist(), n):
                if keys[i] != known:
                    known, pivots = keys[i], {}
                if slot[i] >= 0:
                    pivots[slot[i]] = (doc[i], s)
                    continue
                slots = sorted(pivots)
                shared = np.array([np.isin(s, pivots[p][1], assume_unique=True).sum() for p in slots])
                union = np.array([len(pivots[p][1]) for p in slots]) + len(s) - shared
                far = 1 - shared / np.maximum(1, union)
                cells = [slots[j] for j in np.flatnonzero(far <= far.min() + 2 * eps + 1e-9)]
                near = [pivots[slots[j]][0] for j in np.flatnonzero((100 * shared >= percent * union) & (union > 0))]
                out.append((keys[i][0], doc[i], slots[int(far.argmin())], cells, near))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _fine_points(n: int):
    schema = pa.schema([("family", pa.int64()), ("doc", pa.int64()), ("size", pa.int64()), ("point", pa.binary())])

    def run(batches):
        for batch in batches:
            found = [(len(s), parities(s, FINE_BITS).tobytes()) for _, s in _sets(batch.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("doc"), *(pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), list(schema)[2:], strict=True))], schema=schema)

    return run


def _near_points(percent: int):
    """For rows (family, cell, pair, doc, size, point) sorted by region: links (a, b) that connect all documents that may link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda h: h[1])
        doc, size = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        point = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(len(held), -1)
        root, a, b = np.arange(len(held)), [], []
        for i in range(len(held)):
            # partners of the same size or larger, as far as the triangle inequality with the empty set lets them be
            to = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
            open_ = np.flatnonzero(root[i + 1 : to] != root[i]) + i + 1
            if len(open_):
                apart = np.bitwise_count(point[open_] ^ point[i]).sum(1)
                near = open_[(100 + percent) * apart <= (100 - percent) * (size[open_] + size[i])]
                roots = np.unique(root[near])
                a += [int(doc[i])] * len(roots)
                b += [int(doc[near[root[near] == r][0]]) for r in roots]
                root[np.isin(root, roots)] = root[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def run(batches):
        last, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "cell", "pair", "doc", "size", "point")]
            for *key, doc, size, point in zip(*columns, strict=True):
                if key != last:
                    if len(held) > 1:
                        yield solve(held)
                    last, held = key, []
                if size:
                    held.append((doc, size, point))
        if len(held) > 1:
            yield solve(held)

    return run


def _divided(named: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """doc, family: large families cut into what finer parity points still connect.

    members: family, doc, bytes. Documents meet in cells of sizes; a cell also gets the next smaller one, as linked sizes
    differ by less than a cell. A point is as small as FINE_BITS, whatever the text; cells are joined in pairs of blocks.
    """
    rows = _texts_of(named, members.select("doc", "family").checkpoint()).select("family", "doc", "text")
    points = rows.mapInArrow(_fine_points(n), "family long, doc long, size long, point binary").where("size > 0").checkpoint()
    own = F.floor(F.log("size") / math.log(100 / percent) + 1e-9)
    cells = points.withColumn("cell", F.explode(F.array(own, own + 1)))
    blocks = cells.groupBy("family", "cell").agg(F.ceil(F.count("*") / BLOCK_POINTS).alias("blocks"))
    cells = cells.join(blocks, ["family", "cell"]).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", _numbers("blocks"))
    pair = F.least("own", "other") * 1_000_000 + F.greatest("own", "other")
    cells = cells.select("family", "cell", pair.alias("pair"), "doc", "size", "point")
    # pairs of blocks copy their points, so they are dealt part after part
    parts, links = min(KEY_PARTS, -(-cells.count() // PART_ROWS)) or 1, []
    for part in range(parts):
        own = cells.where(F.pmod(F.xxhash64("family", "cell", "pair"), F.lit(parts)) == part)
        own = own.repartition("family", "cell", "pair").sortWithinPartitions("family", "cell", "pair")
        links.append(own.mapInArrow(_near_points(percent), "a long, b long").checkpoint())
        del own
        release(named.sparkSession)
    return components(functools.reduce(DataFrame.union, links)).withColumnsRenamed({"node": "doc", "label": "family"})


def _block_counts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, name: the blocks of bounded size that each group is cut into."""
    n = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1).cast("long"))
    return rows.groupBy(*by).agg(n.alias(name))


def _numbers(count: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def _large_families(named: DataFrame, members: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with pivots, and the regions (family, region, doc, probe) that hold all other links, of families too large
    for a task. members: family, doc, bytes.

    What the pivots join is one component already; only documents outside a family's largest one still need partners.
    They go, as probes, to each cell that can hold one; every document waits in its own cell. Cells are cut into
    blocks of probes and blocks of documents, and each pair of blocks is a region.
    """
    order = F.xxhash64("doc")
    pivots = members.groupBy("family", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(F.min_by("doc", order).alias("doc"))
    salts = _block_counts(members, ["family"], "salts")
    wanted = members.join(salts, "family").select("doc", "family", F.pmod(order, F.col("salts")).alias("salt"), F.lit(-1).cast("long").alias("slot"))
    wanted = wanted.union(pivots.join(salts, "family").select("doc", "family", _numbers("salts").alias("salt"), "slot"))
    texts = _texts_of(named, wanted.checkpoint()).select("family", "salt", "slot", "doc", "text")
    texts = texts.repartition("family", "salt").sortWithinPartitions("family", "salt", F.desc("slot"))
    dealt = texts.mapInArrow(_cells(n, percent), "family long, doc long, nearest long, cells array<long>, near array<long>").checkpoint()
    links = dealt.select(F.col("doc").alias("a"), F.explode("near").alias("b"))
    labels = components(links).withColumnsRenamed({"node": "doc"})
    known = dealt.join(labels, "doc", "left").join(members, ["family", "doc"]).withColumn("label", F.coalesce("label", "doc"))
    counts = known.groupBy("family", "label").agg(F.count_distinct("doc").alias("n"))
    main = counts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    probes = known.join(main, "family").where("label <> main").select("family", "doc", "bytes", F.explode("cells").alias("cell")).distinct().checkpoint()
    waiting = known.select("family", "doc", "bytes", F.col("nearest").alias("cell")).distinct()
    by = ["family", "cell"]
    cut = _block_counts(probes, by, "p").join(_block_counts(waiting, by, "w"), by)
    asked = probes.join(cut, by).select("family", "cell", "doc", F.pmod(order, F.col("p")).alias("pb"), _numbers("w").alias("wb"), F.lit(True).alias("probe"))
    there = waiting.join(cut, by).select("family", "cell", "doc", _numbers("p").alias("pb"), F.pmod(order, F.col("w")).alias("wb"), F.lit(False).alias("probe"))
    region = (F.col("cell") * 1_000_000 + F.col("pb")) * 1_000_000 + F.col("wb") + 1
    regions = asked.union(there).groupBy("family", region.alias("region"), "doc").agg(F.bool_or("probe").alias("probe"))
    return links, regions


def similarity_groups(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links): one row per row of docs.

    A-Z are lower-cased; words are runs of characters other than space and 0x09-0x0D. A text with fewer than n
    words is one shingle. Null texts and texts without words: no shingles, linked with nothing. Rows that repeat
    an id are one document with several texts. Null ids: no part in links, component_id null. Columns other
    than id and text are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = base.where("doc is not null")
    # texts without words link nothing, also not the ids that share one
    worded = named.where(F.col("text").rlike(WORD))
    ids = worded.select("doc", F.unhex(F.md5("text")).alias("sig"), F.octet_length("text").cast("long").alias("bytes")).checkpoint()
    # of exact copies the smallest id takes part; its texts are those of its own rows
    lead = ids.groupBy("sig").agg(F.min("doc").alias("doc"), F.max("bytes").alias("bytes"))

    # texts are read where they lie; only the members of families move
    points = base.mapInArrow(_points(n), "doc long, n_shingles long, point binary").checkpoint()
    placed = points.where("doc is not null").dropDuplicates(["doc", "point"]).checkpoint()
    release(docs.sparkSession)

    def stars(of: DataFrame) -> DataFrame:
        # points are much wider than keys: part after part of the keys takes them along, and gives its disk back
        parts = min(KEY_PARTS, -(-of.count() // PART_ROWS)) or 1
        links = []
        for part in range(parts):
            own = of if parts == 1 else of.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)) == part)
            near = own.join(placed, "doc").repartition("key").sortWithinPartitions("key", "n_shingles", "doc")
            near = near.select("key", "doc", "known", "n_shingles", "point").mapInArrow(_leaders(percent), "a long, b long")
            links.append(near.checkpoint())
            del own, near
            release(of.sparkSession)
        return functools.reduce(DataFrame.union, links)

    # copies agree on most keys: some keys join them, and what one family holds of any other key needs no link. There are several hundred
    # keys a document, and in a large corpus most are shared: a pass holds its own keys on disk, no longer than it lasts
    passes = min(-(-(100 - percent) // PASS_PERCENT), -(-(ids.agg(F.sum("bytes")).first()[0] or 0) // PASS_BYTES)) or 1
    families, same_key = None, Window.partitionBy("key")
    for at in range(passes + 1):
        rows = named.mapInArrow(_key_rows(n, percent, at, passes), "key long, doc long, pivot long")
        if families is None:
            rows = rows.withColumn("known", F.col("doc"))
        else:
            label = families.withColumnsRenamed({"node": "doc", "label": "known"})
            rows = rows.join(F.broadcast(label) if label.count() <= BROADCAST else label, "doc", "left").withColumn("known", F.coalesce("known", "doc"))
        rows = rows.withColumns({"low": F.min("known").over(same_key), "high": F.max("known").over(same_key)})
        rows = rows.where("pivot is not null or low < high").drop("low", "high").checkpoint()
        release(docs.sparkSession)
        links = stars(rows.where("pivot is null").drop("pivot")).union(rows.where("pivot is not null").select("doc", "pivot"))
        families = components(links if families is None else links.union(families)).checkpoint()
        del rows, links
        release(docs.sparkSession)
    families = families.withColumnsRenamed({"node": "doc", "label": "family"})
    sized = lead.join(families, "doc").groupBy("family", "doc").agg(F.sum("bytes").alias("bytes")).checkpoint()
    totals, large = _sizes_of(sized)
    if large.limit(1).count():
        inner = sized.join(large, "family").checkpoint()
        divided = inner.drop("family").join(_divided(named, inner, n, percent), "doc").select("family", "doc", "bytes")
        sized = sized.join(large, "family", "left_anti").select("family", "doc", "bytes").union(divided).checkpoint()
        totals, large = _sizes_of(sized)
    small = totals.join(large, "family", "left_anti").select("family")
    regions = sized.join(small, "family").select("family", F.lit(0).cast("long").alias("region"), "doc", F.lit(None).cast("boolean").alias("probe"))
    links = None
    if large.limit(1).count():
        links, more = _large_families(named, sized.join(large, "family").select("family", "doc", "bytes"), n, percent)
        regions = regions.union(more.select("family", "region", "doc", "probe"))
    placed = _texts_of(named, regions.checkpoint()).select("family", "region", "doc", "probe", "text")
    placed = placed.repartition("family", "region").sortWithinPartitions("family", "region", "doc")
    found = placed.mapInArrow(_regions(n, percent), "a long, b long")
    links = found if links is None else links.union(found)
    # an id with several texts joins their leads
    several = ids.select("doc", "sig").distinct().join(lead.select("sig", F.col("doc").alias("lead")), "sig")
    links = links.union(several.where("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b")))
    found = components(links).withColumnsRenamed({"node": "doc", "label": "component"})

    alone = (F.col("n_shingles") == 0) | F.col("component").isNull()
    return points.join(found, "doc", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.when(alone, F.col("doc")).otherwise(F.col("component")).alias("component_id"))


def _sizes_of(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families of two and more, with their size; those too large for one task."""
    totals = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where("n > 1").checkpoint()
    return totals, totals.where((F.col("n") > BLOCK_DOCS) | (F.col("b") > BLOCK_BYTES)).select("family").checkpoint()


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (doc, text) of wanted docs, with wanted's columns. Up to BROADCAST wanted rows go to the texts, beyond that both are shuffled."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "doc")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return similarity_groups(table(spark, sf_dir, "documents"))


def brute(rows: list[tuple], n: int = 3, percent: int = 90) -> dict:
    """doc_id: (n_shingles, component_id) for (doc_id, text) rows with distinct ids, by comparing all pairs."""
    sets, root = {}, {}
    for doc, text in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        root[doc] = doc

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = sorted(x for x in sets if sets[x])
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
