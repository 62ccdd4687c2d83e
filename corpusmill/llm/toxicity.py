"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows: one for the word, some for its beginnings and its end, so that unseen
forms of a known stem are recognised. Filters of several widths run over the whole text; the largest response of each
goes to a logistic output. It is trained on a bounded sample of labelled rows, then scaled on a part of the
sample that training didn't see, at the classes' shares among all labelled rows; there the thresholds by language
are set, too. A score depends on the text alone.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .wordhash import Words, chunks

#: Labelled rows of each class that are trained on, at most: those of smallest hash, and of these as many as hold so many bytes of text.
SAMPLE, SAMPLE_BYTES = 2_500, 32 << 20
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
#: Texts that training sees, with repeats, and passes over the sample at least and at most.
VISITS, PASSES = 20_000, (6, 40)
#: Beginnings of a word, in bytes, that are features beside the word itself; and its last bytes.
STARTS, END = (3, 4, 5, 6), 4
#: A language's own threshold is set if the calibration rows hold so many of either class.
LEAST = 20


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words, features) of all words, and the index of each text's first word.

    Words are runs of letters and digits; ASCII and Latin-1 letters are lower-cased.
    """
    words = Words(texts, letters=True)
    start, end = words.start, words.end
    spans = [(start, end), *((start, np.minimum(start + n, end)) for n in STARTS), (np.maximum(end - END, start), end)]
    out = np.empty((len(start), len(spans)), np.int32)
    for j, (a, b) in enumerate(spans):
        out[:, j] = (words.spans(a, b, j * 0x1F123BB5 + 1) >> np.uint64(40)).astype(np.int64) % BUCKETS
    return out, words.first


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rows = (rng.normal(0, 0.1, (BUCKETS, SIZE))).astype(np.float32)
        self.conv = {w: rng.normal(0, (1 / (w * SIZE)) ** 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base, self.scale, self.shift = np.float32(0), 1.0, 0.0
        self.thresholds: dict[str | None, float] = {}

    def respond(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of a text's words, with as many zeros after them as the widest filter needs; all responses."""
        words = np.zeros((len(feats) + max(WIDTHS) - 1, SIZE), np.float32)
        for j in range(feats.shape[1]):
            words[: len(feats)] += self.rows[feats[:, j]]
        n = len(feats)
        return words, np.concatenate([sum(words[j : j + n] @ self.conv[w][j] for j in range(w)) for w in WIDTHS], 1)

    def logits(self, texts: list) -> np.ndarray:
        """Of whole texts, in any number; null is an empty text. Long texts are read in parts that overlap."""
        out = []
        for _, group in chunks(texts):
            feats, first = features(group)
            for i in range(len(group)):
                pooled = np.zeros(len(self.bias), np.float32)
                for at in range(first[i], first[i + 1], 50_000):
                    part = feats[at : min(at + 50_000 + max(WIDTHS) - 1, first[i + 1])]
                    if len(part):
                        pooled = np.maximum(pooled, self.respond(part)[1].max(0) + self.bias)
                out.append(float(pooled @ self.out + self.base))
        return np.array(out)

    def score(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -30, 30)))

    def train(self, texts: list, labels: np.ndarray, seed: int = 4) -> None:
        rng, held = np.random.default_rng(seed), []
        for _, group in chunks(texts):
            feats, first = features(group)
            held += [feats[first[i] : first[i + 1]] for i in range(len(group))]
        squares = np.full(BUCKETS, 1e-2, np.float32)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (*self.conv.items(), ("out", self.out), ("bias", self.bias))}
        step, epochs = 0, int(np.clip(VISITS // max(1, len(held)), *PASSES))
        # both classes weigh alike in sum
        weight = np.where(labels == 1, len(labels) / max(1, 2 * (labels == 1).sum()), len(labels) / max(1, 2 * (labels != 1).sum())).astype(np.float32)
        for epoch in range(epochs):
            for batch in np.array_split(rng.permutation(len(held)), max(1, len(held) // 16)):
                grads = {k: np.zeros_like(m[0]) for k, m in moments.items()}
                base, touched, moved = 0.0, [], []
                for i in batch:
                    if not len(held[i]):
                        continue
                    words, response = self.respond(held[i])
                    at = response.argmax(0)
                    pooled = response[at, np.arange(len(at))] + self.bias
                    on = pooled > 0
                    # dropout keeps single filters from deciding alone
                    keep = on * (rng.random(len(on)) > 0.2) / 0.8
                    error = 1 / (1 + np.exp(-np.clip((pooled * keep) @ self.out + self.base, -30, 30))) - labels[i]
                    error *= weight[i]
                    base += error
                    grads["out"] += error * pooled * keep
                    back = (error * self.out * keep).astype(np.float32)
                    grads["bias"] += back
                    for n, w in enumerate(WIDTHS):
                        own = slice(n * FILTERS, (n + 1) * FILTERS)
                        for j in range(w):
                            where = at[own] + j
                            grads[w][j] += (words[where] * back[own, None]).T
                            real = where < len(held[i])
                            touched.append(held[i][where[real]])
                            moved.append((self.conv[w][j] * back[own]).T[real])
                step += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.001
                for k, (m, v) in moments.items():
                    g = grads[k] / len(batch)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    target = self.conv[k] if k in self.conv else getattr(self, k)
                    target -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
                self.base -= np.float32(rate * base / len(batch))
                if touched:
                    rows, grad = np.concatenate(touched), np.concatenate(moved) / len(batch)
                    index, inverse_ = np.unique(rows.ravel(), return_inverse=True)
                    total = np.zeros((len(index), SIZE), np.float32)
                    np.add.at(total, inverse_.reshape(rows.shape), grad[:, None, :])
                    squares[index] += (total**2).mean(1)
                    self.rows[index] -= 0.15 * total / np.sqrt(squares[index])[:, None]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: list, share: float) -> None:
        """Scale and shift of the logit, at the given share of class 1; thresholds by language."""
        ones = labels == 1
        if not ones.any() or ones.all():
            return
        weight = np.where(ones, share / ones.sum(), (1 - share) / (~ones).sum())
        centre, spread = logits.mean(), logits.std() + 1e-6
        z, a, b = (logits - centre) / spread, 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - labels) * weight * z).sum() + 1e-3 * a, ((p - labels) * weight).sum()])
            curve = weight * p * (1 - p)
            h = np.array([[(curve * z * z).sum() + 1e-3, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-6]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.scale, self.shift = float(a / spread), float(b - a * centre / spread)
        score = 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))
        for lang in {x for x in langs if x is not None}:
            own = np.array([x == lang for x in langs])
            if min((own & ones).sum(), (own & ~ones).sum()) >= LEAST:
                cuts = np.concatenate(([0.5], np.unique(score[own])))
                wrong = [weight[own & ones & (score < c)].sum() + weight[own & ~ones & (score >= c)].sum() for c in cuts]
                best = np.flatnonzero(np.isclose(wrong, min(wrong)))
                # between equally good cuts: the middle one; 0.5 if it is among them
                self.thresholds[lang] = 0.5 if 0 in best else float(cuts[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The classifier, from labelled rows of docs whose crc32(id as text) mod 5 is not 0.

    docs: doc_id, text, lang; labels: doc_id, toxic; other columns take no part. Rows without id or label take no part; of
    repeated labels the largest counts. Without rows of both classes, or texts of them, the model says 0.5 or what there is: the class's share.
    One task trains on the sample; the driver gets the model alone.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where("toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).checkpoint()
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    if not 0 < share < 1:
        return _constant({0: -4.0, 1: 4.0}[share] if count else 0.0)
    order = F.xxhash64("doc_id")
    # ids first, so that no more than the sample's texts are moved
    ids = [known.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(sample) for toxic in (0, 1)]
    ids = ids[0].union(ids[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = own.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])
    before = Window.partitionBy("toxic").orderBy(order, "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < sample_bytes).drop("before")
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "text", "lang")
    trained = rows.mapInArrow(_trainer(share), "model binary").collect()
    return pickle.loads(trained[0]["model"]) if trained else _constant(float(np.log(share / (1 - share))))


def _constant(logit: float) -> Model:
    """A model that says the same of every text."""
    model = Model()
    model.base, model.out[:], model.shift = np.float32(0), 0, logit
    return model


def _trainer(share: float):
    def run(batches):
        texts, toxic, langs = [], [], []
        for batch in batches:
            for column, held in (("text", texts), ("toxic", toxic), ("lang", langs)):
                held += batch.column(column).to_pylist()
        if not texts:
            return
        model, labels = Model(), np.array(toxic, np.float32)
        aside = np.arange(len(texts)) % 4 == 3
        model.train([t for t, x in zip(texts, aside, strict=True) if not x], labels[~aside])
        rest = np.flatnonzero(aside)
        model.calibrate(model.logits([texts[i] for i in rest]), labels[rest], [langs[i] for i in rest], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id, score and rejected (score at its language's threshold or above; 0.5 where none is set), per row of docs.

    Null and empty texts get the score of a text without words. A null language has threshold 0.5. Repeated rows
    get a row each, null ids stay null. Other columns are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("rejected", pa.bool_())])
        for batch in batches:
            score = sent.value.score(batch.column("text").to_pylist())
            cut = np.array([sent.value.thresholds.get(x, 0.5) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(score >= cut, pa.bool_())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "doc_id long, score double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, at the thresholds by language. Columns as in docs."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = sent.value.score(batch.column("text").to_pylist())
            cut = np.array([sent.value.thresholds.get(x, 0.5) for x in batch.column("lang").to_pylist()])
            yield batch.filter(pa.array(score < cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
