"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one word from each of a few full-dimensional codebooks. The codebooks start as
residual k-means on a bounded sample, and are then refitted together by least squares; every row is encoded by beam
search, and its code and the norm of its approximation are stored beside the original. A query is scored against
codes by adding up table entries (its products with all words); the best of each block of rows are scored again on
the original vectors in double precision.

Queries are broadcast in blocks of bounded size. Exact copies of a vector are one index entry with the smallest
ids, as many as a result can hold and one more, so a vector that fills a third of the table fills no task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Rows that the codebooks are fitted on, at most: those of smallest hash.
SAMPLE = 12_288
BOOKS, WORDS, BEAM = 8, 256, 4
#: Rows of an index block, those of a block that are scored exactly for each query, and queries broadcast at once.
BLOCK, SHORTLIST, QUERY_BLOCK = 8_192, 1_200, 20_000


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimensions) for rows x."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    words = min(words, len(x))
    rest, out = x.copy(), np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        centre = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            own = (rest @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            count = np.bincount(own, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, own, rest)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        out[m] = centre
        rest -= centre[(rest @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)]
    for _ in range(2):
        codes = encode(x, out)[0]
        flat = codes + np.arange(books) * words
        gram, right = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(right, flat[:, a], x)
            for b in range(books):
                np.add.at(gram, (flat[:, a], flat[:, b]), 1)
        gram[np.diag_indices(len(gram))] += 0.1
        out = np.linalg.solve(gram, right + 0.1 * out.reshape(-1, x.shape[1])).reshape(out.shape).astype(np.float32)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) by beam search, and the squared norm of each approximation."""
    count, words, _ = books.shape
    flat = books.reshape(count * words, -1)
    inner, norm = flat @ flat.T, (flat**2).sum(1)
    codes, norms = np.zeros((len(x), count), np.int64), np.zeros(len(x), np.float32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float32)
        dot = part @ flat.T
        n = len(part)
        cost, path = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
        for m in range(count):
            own = slice(m * words, (m + 1) * words)
            new = cost[:, :, None] + (norm[own] - 2 * dot[:, own])[:, None, :]
            for j in range(m):
                new += 2 * inner[path[:, :, j] + j * words][:, :, own]
            new = new.reshape(n, -1)
            best = np.argpartition(new, min(beam, new.shape[1]) - 1, 1)[:, :beam]
            row = np.arange(n)[:, None]
            cost = new[row, best]
            path = np.concatenate((path[row, best // words], (best % words)[:, :, None]), 2)
        first = cost.argmin(1)
        codes[at : at + 512] = path[np.arange(n), first]
        picked = (codes[at : at + 512] + np.arange(count) * words)
        norms[at : at + 512] = (flat[picked].sum(1) ** 2).sum(1)
    return codes, norms


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _encoded(books):
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("embedding", pa.list_(pa.float32())), ("code", pa.binary()), ("norm", pa.float32())])

    def run(batches):
        for batch in batches:
            if len(batch):
                codes, norms = encode(_matrix(batch.column("embedding"), np.float32), books.value)
                code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ids").cast(schema.field(0).type), batch.column("embedding").cast(schema.field(1).type), code, pa.array(norms)], schema=schema)

    return run


class Best:
    """The k best of the rows seen so far, for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, books: np.ndarray, k: int, metric: str):
        self.ids, self.vectors, self.books, self.k, self.metric = ids, vectors, books, k, metric
        self.held = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def add(self, rows: list[list[int]], x: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        smallest = np.array([r[0] for r in rows])
        short = min(len(rows), max(SHORTLIST, 4 * (self.k + 1)))
        for at in range(0, len(self.ids), 128):
            q = self.vectors[at : at + 128].astype(np.float32)
            score = np.zeros((len(q), len(rows)), np.float32)
            for m, book in enumerate(self.books):
                score += np.take(q @ book.T, codes[:, m], axis=1)
            if self.metric == "l2":
                score = 2 * score - norms
            near = np.argpartition(-score, short - 1, 1)[:, :short]
            for j in range(len(q)):
                self._merge(at + j, rows, x, smallest, np.sort(near[j]))

    def _merge(self, i: int, rows: list[list[int]], x: np.ndarray, smallest: np.ndarray, near: np.ndarray) -> None:
        q = self.vectors[i]
        exact = (x[near] * q).sum(1) if self.metric == "ip" else -((x[near] - q) ** 2).sum(1)
        top = np.lexsort((smallest[near], -exact))[: self.k + 1]
        score, ids = [self.held[i][0]], [self.held[i][1]]
        for t in top:
            own = rows[near[t]]
            score.append(np.full(len(own), exact[t]))
            ids.append(np.array(own))
        score, ids = np.concatenate(score), np.concatenate(ids)
        other = ids != self.ids[i]
        score, ids = score[other], ids[other]
        order = np.lexsort((ids, -score))[: self.k]
        self.held[i] = (score[order], ids[order])


def _searched(ids, vectors, books, k: int, metric: str):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        best = Best(ids.value, vectors.value, books.value, k, metric)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1)
                best.add(part.column("ids").to_pylist(), _matrix(part.column("embedding"), np.float64), codes, part.column("norm").to_numpy())
        for at in range(0, len(best.ids), 2000):
            held = best.held[at : at + 2000]
            query = np.repeat(best.ids[at : at + 2000], [len(s) for s, _ in held])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([d for _, d in held])), pa.array(np.concatenate([s for s, _ in held]))], schema=schema)

    return run


def usable(embedding: Column) -> Column:
    """True for vectors without nulls, NaN and infinities that are not zero."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, metric: str = "ip", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each query, ties to the smaller id.

    queries is a condition on the column vec_id; a query is no neighbour of itself. metric: ip (largest inner product) or l2
    (score: minus the squared distance). Null or unusable vectors and null ids take no part, nor do vectors whose
    dimension isn't the most frequent one (of the largest, in a tie). Rows that repeat an id: the one of the smallest
    vector takes part. Fewer than k candidates: all of them. Other columns are ignored. No usable vector: an empty
    result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    dims = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return none
    rows = rows.where(F.size("embedding") == dims[0]["dims"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).checkpoint()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    index = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    index = index.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sample = index.orderBy(F.xxhash64(F.element_at("ids", 1))).limit(SAMPLE).select("embedding").toArrow()
    if not len(sample):
        return none
    books = spark.sparkContext.broadcast(fit(_matrix(sample.column(0).combine_chunks(), np.float32)))
    # a partition of the index is some blocks: that bounds what a task holds, and what it sends on for each query
    parts = max(1, -(-rows.count() // (2 * BLOCK)))
    index = index.select("ids", "embedding").repartition(parts).mapInArrow(_encoded(books), "ids array<long>, embedding array<float>, code binary, norm float").checkpoint()
    asked = rows.where(queries)
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = none.select("query_id", "vec_id", "score")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if len(part):
            ids, points = (spark.sparkContext.broadcast(a) for a in (part.column(0).to_numpy(), _matrix(part.column(1).combine_chunks(), np.float64)))
            found = found.union(index.mapInArrow(_searched(ids, points, books, k, metric), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
