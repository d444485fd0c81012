"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams each have a learned vector; a
document is the average of its vectors; a softmax layer gives the class. Both
layers are trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mix64, slices, span_hashes, word_bounds

#: Labelled documents of each class that training reads at most, the first by a hash of doc_id, whole.
SAMPLE = 2000
#: Features (distinct in a document) of the sample at most; the documents beyond are left out. 8 bytes each.
SAMPLE_FEATURES = 32_000_000
BUCKET_BITS = 18
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.1
SLICE_BYTES = 1 << 20
#: Character n-grams are taken over the bytes of the text, white space included.
GRAMS = (3, 4)

_GRAM_MULTIPLIER = np.uint32(2654435761)


def _gram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """A bucket for the n bytes that start at each position (the last n-1 have none)."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    code = raw[:m].astype(np.uint32)
    for i in range(1, n):
        code |= raw[i : i + m].astype(np.uint32) << np.uint32(8 * i)
    code *= _GRAM_MULTIPLIER
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519 + 2 * n)
    return (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _feature_groups(raw: np.ndarray, at: np.ndarray):
    """Per kind of feature: its buckets, and the first and last of them for each row.

    The kinds have vectors of their own: words, pairs, then the n-grams.
    """
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    starts, stops, rows = word_bounds(space, at)
    h = span_hashes(raw, starts, stops)
    shift = np.uint64(64 - BUCKET_BITS)
    yield (h >> shift).astype(np.int64), rows[:-1], rows[1:]
    # A word after itself is one feature, whatever the word.
    pair = mix64((h[1:] - h[:-1]) * np.uint64(0x9E3779B97F4A7C15))
    yield (pair >> shift).astype(np.int64), rows[:-1], np.maximum(rows[:-1], rows[1:] - 1)
    for n in GRAMS:
        yield _gram_buckets(raw, n), at[:-1], np.maximum(at[:-1], at[1:] - n + 1)


KINDS = 2 + len(GRAMS)


@dataclass
class Model:
    #: By kind of feature and bucket: what a feature adds to the log odds of class 1.
    weights: np.ndarray
    bias: float

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for kind, (buckets, first, last) in enumerate(_feature_groups(raw, at)):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.weights[kind][buckets], out=sums[1:])
            first, last = np.minimum(first, len(buckets)), np.minimum(last, len(buckets))
            total += sums[last] - sums[first]
            count += last - first
        return total / np.maximum(count, 1) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*joined(column)), -700, 700)))


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct features, and the share of each."""
    raw, at = joined(pa.array([text or ""], pa.string()))
    found = np.concatenate([buckets[int(a[0]) : int(b[0])] + (kind << BUCKET_BITS) for kind, (buckets, a, b) in enumerate(_feature_groups(raw, at))])
    unique, n = np.unique(found, return_counts=True)
    return unique.astype(np.int32), (n / max(1, len(found))).astype(np.float32)


def train(rows, epochs: int = EPOCHS, rate: float = RATE, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Train on (text, label) rows; classes weigh alike whatever their numbers.

    With no rows, or one class only, the model gives that class (class 1 for no
    rows) to every text.
    """
    size = 1 << BUCKET_BITS
    labels, cut = [], [0]
    ids_of, share_of = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.float32)
    for text, label in rows:
        unique, share = _features(text)
        if cut[-1] and cut[-1] + len(unique) > SAMPLE_FEATURES:
            break
        while cut[-1] + len(unique) > len(ids_of):
            ids_of, share_of = np.resize(ids_of, 2 * len(ids_of)), np.resize(share_of, 2 * len(share_of))
        labels.append(label)
        cut.append(cut[-1] + len(unique))
        ids_of[cut[-2] : cut[-1]], share_of[cut[-2] : cut[-1]] = unique, share
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros((KINDS, size), np.float32), 5.0 if not len(y) or y[0] else -5.0)
    rng = np.random.default_rng(seed)
    # The features of the sample by falling number of documents: the rows that most documents touch lie close together.
    held = np.bincount(ids_of[: cut[-1]], minlength=KINDS * size)
    order = np.argsort(-held, kind="stable")[: int((held > 0).sum())]
    rank = np.empty(KINDS * size, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    ids_of = rank[ids_of[: cut[-1]]]
    start = rng.uniform(-1 / dimensions, 1 / dimensions, (KINDS * size, dimensions)).astype(np.float32)
    inner = start[order]
    outer = rng.uniform(-0.5, 0.5, (2, dimensions)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_inner, seen_outer, seen_bias = np.full(len(order), 1e-12, np.float32), np.full_like(outer, 1e-4), np.full_like(bias, 1e-2)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - step / steps)
            step += 1
            ids, share = ids_of[cut[i] : cut[i + 1]], share_of[cut[i] : cut[i + 1]]
            rows_of = inner.take(ids, axis=0)
            hidden = share @ rows_of
            z = outer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = (p * min(4.0, weight[y[i]])).astype(np.float32)
            back, across = outer.T @ g, np.outer(g, hidden)
            # Steps are scaled by the gradients that a row has seen: rare features move as far as common ones.
            seen_outer += across**2
            seen_bias += g**2
            outer -= lr * across / np.sqrt(seen_outer)
            bias -= lr * g / np.sqrt(seen_bias)
            seen = seen_inner.take(ids)
            seen += share * share * (back @ back)
            seen_inner[ids] = seen
            np.sqrt(seen, out=seen)
            np.divide(share, seen, out=seen)
            rows_of -= np.outer(seen, np.float32(lr) * back)
            inner[ids] = rows_of
    start[order] = inner
    weights = (start @ (outer[1] - outer[0])).reshape(KINDS, size).astype(np.float32)
    return Model(weights, float(bias[1] - bias[0]))


def held_out(column: str = "doc_id"):
    return F.expr(f"coalesce(crc32(cast(cast({column} as string) as binary)) % 3 = 1, false)")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame | None:
    """A bounded sample of labelled texts outside the held-out fold: doc_id, text, label; None without one.

    Of a document with several labels, or several rows, one is used; labels
    other than 0 and 1 are left out. Only ids and labels come to the driver.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    picked = None
    for q in (0, 1):
        # orderBy + limit keeps at most `sample` rows a task; no full sort
        one = usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = one if picked is None else picked.unionAll(one)
    chosen = {r["doc_id"]: r["quality"] for r in picked.orderBy("doc_id", "quality").collect()}
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "_id long, label int")  # 2 * sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model trained in one task on the executors, over the sample in order of a hash of doc_id."""
    rows = training_rows(docs, labels, sample)
    if rows is None:
        return train([])

    def run(batches):
        model = train((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column("text"), b.column("label")))
        yield pa.RecordBatch.from_pydict({"bias": pa.array([model.bias], pa.float64()), "weights": pa.array([model.weights.tobytes()], pa.binary())})

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(run, "bias double, weights binary").collect()
    if not got:
        return train([])
    return Model(np.frombuffer(got[0]["weights"], np.float32).reshape(KINDS, 1 << BUCKET_BITS), got[0]["bias"])


def _scorer(shared):
    def run(batches):
        model = shared.value
        for b in slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the bias alone; documents without a
    doc_id are scored and count as not held out. Repeated rows each get a row.
    Only the text enters a score. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.expr("cast(if(score >= 0.5, 1, 0) as int)").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject.

    Null and empty texts stand or fall with the bias alone, and each repeated
    row for itself. Other columns are carried along whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    def keep(batches):
        for b in slices(batches, at, SLICE_BYTES):
            yield b.filter(pa.array(shared.value.scores(b.column(at)) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
