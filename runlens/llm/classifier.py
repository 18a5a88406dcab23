"""op10: quality classifier, Naive Bayes support vectors (NB-SVM).

* Features: indicators of word and word-shape n-grams (1 and 2 words; a shape folds letters, capitals and digits to one sign
  per run), plus "same word twice" and "three times in a row", hashed to ``buckets`` ids. Label, language, source and id are never features.
* Class log-count ratios ``r`` come from every labelled training row: each task counts its documents per class and bucket, Spark
  sums them. Buckets seen in fewer than ``min_docs`` documents get ``r = 0``.
* The linear hinge-loss model on ``r``-scaled, length-normalised indicators is fitted by dual coordinate descent on
  a bounded sample: per class the ``sample`` labelled training rows with the smallest seeded hash of the id. A quarter of the
  sample is left out of the descent and fits the logistic curve that turns margins into scores, weighted to the classes' shares
  among the labels.
* Scoring is one pass over all documents with a table of ``buckets`` weights (its size is a parameter).

Texts meet their labels in one exchange on doc_id, at every size (labels grow with the corpus, so they are not broadcast).

What reaches the driver: at most ``buckets`` summed rows and 2 * ``sample`` feature lists.

Defined results: a null or empty text has no features and gets the score of a zero margin sum; a label that is null, not 0 or 1,
or contradicted by another label of its doc_id is not learnt from; repeated rows count each; without labels of both classes
every score is the share of label 1 (0.5 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import U64, by_value, mix64, slices, span_hash, stored, text_buffer, training_row, words

BUCKETS = 1 << 18
SAMPLE = 3000          # rows per class that the descent and the calibration see
MIN_DOCS = 5
EPOCHS = 8
COST = 1.0
KEEP = 0.7
PART_BYTES = 2 << 20   # text whose features are made together

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")


def shape_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: character classes with runs folded."""
    cls = _SHAPE[buf]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hash(cls[keep], at[start], at[end])


def features(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of every row, sorted by row."""
    buf, off = text_buffer(col)
    w = words(buf, off)
    h, s, row = w.hash, shape_hashes(buf, w.start, w.end), w.row
    pair = row[1:] == row[:-1]
    a, b, r2 = h[:-1][pair], h[1:][pair], row[1:][pair]
    sa, sb = s[:-1][pair], s[1:][pair]
    k = U64(0x9E3779B97F4A7C15)
    again = a == b
    thrice = np.flatnonzero(again[1:] & again[:-1] & (r2[1:] == r2[:-1]))
    parts = [(row, h), (row, s + U64(1)), (r2, mix64(a * k + b)), (r2, mix64(sa * k + sb) + U64(2)),
             (r2[again], np.full(int(again.sum()), 3, U64)), (r2[thrice], np.full(len(thrice), 4, U64))]
    key = np.concatenate([(r.astype(U64) << U64(32)) | (mix64(x) % U64(buckets)) for r, x in parts])
    key.sort()
    key = key[np.diff(key, prepend=~key[:1]) != 0] if len(key) else key
    return (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)


_TRAIN = pa.schema([("bucket", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64()), ("label", pa.int32()),
                    ("h", pa.int64()), ("f", pa.list_(pa.int32()))])
TRAIN = "bucket int, pos long, neg long, label int, h long, f array<int>"


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, buckets: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(class counts per bucket of all labelled training documents and the sample's feature lists, labels per class)."""
    known = (labels.where(training_row(4, 2) & F.col("quality").isin(0, 1)).groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
             .where("label = other").drop("other")
             .withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    # hashes up to these are emitted as sample candidates: about twice the wanted rows per class
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    top = {c: -(1 << 63) + min((1 << 64) - 1, ((1 << 64) * 2 * sample) // max(m, 1)) for c, m in n.items()}
    joined = docs.select("doc_id", "text").where(training_row(4, 2)).join(known.hint("merge"), "doc_id").select("text", "label", "h")

    def run(batches):
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in slices([batch], PART_BYTES):
                row, bucket = features(part.column("text"), buckets)
                label = np.asarray(part.column("label"))
                for c in (0, 1):
                    counts[c] += np.bincount(bucket[label[row] == c], minlength=buckets)
                h = np.asarray(part.column("h"))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                take = [i for i in range(part.num_rows) if h[i] <= top[int(label[i])]]
                if take:
                    m = len(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                         pa.array(label[take], pa.int32()), pa.array(h[take]),
                         pa.array([bucket[cut[i]:cut[i + 1]] for i in take], pa.list_(pa.int32()))], schema=_TRAIN)
        at = np.flatnonzero(counts.any(axis=0))
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(counts[1][at]), pa.array(counts[0][at]), pa.nulls(m, pa.int32()),
             pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32()))], schema=_TRAIN)

    return joined.mapInArrow(run, TRAIN), n


def descend(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Weights (last one: bias) of the hinge-loss model by dual coordinate descent; x holds bucket lists."""
    w = np.zeros(len(r) + 1)
    alpha = np.zeros(len(x))
    vals = [np.append(r[f], 1.0) / np.sqrt(len(f) + 1) for f in x]
    at = [np.append(f, len(r)) for f in x]
    sq = np.array([v @ v for v in vals])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w[at[i]] @ vals[i]) - 1
            new = min(max(alpha[i] - g / sq[i], 0.0), cost)
            if new != alpha[i]:
                w[at[i]] += (new - alpha[i]) * y[i] * vals[i]
                alpha[i] = new
    return w


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of score = 1 / (1 + exp(-(a * margin + b))), weighted logistic fit with smoothed targets."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack([margin, np.ones(len(margin))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (t - p)) - 1e-3 * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


class Model:
    """Bucket weights, bias, and the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        s = np.bincount(row, self.weights[bucket].astype(float), minlength=n)
        return (s + self.bias) / np.sqrt(np.bincount(row, minlength=n) + 1)

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, min_docs: int = MIN_DOCS,
        cost: float = COST, epochs: int = EPOCHS, seed: int = 10) -> Model:
    rows, labelled = training_rows(docs, labels, sample, buckets, seed)
    rows = stored(rows, "nbsvm_train")
    counts = (rows.where("bucket is not null").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .toPandas())
    p, q = np.zeros(buckets), np.zeros(buckets)
    p[counts.bucket], q[counts.bucket] = counts.pos, counts.neg
    r = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    r[p + q < min_docs] = 0
    picked = pd.concat([rows.where(F.col("label") == c).select("label", "h", "f").orderBy("h").limit(sample).toPandas()
                        for c in (0, 1)], ignore_index=True)
    n = [int((picked.label == c).sum()) for c in (0, 1)]
    if not all(n):
        share = 0.5 if not sum(n) else (0.999 if n[1] else 0.001)
        return Model(np.zeros(buckets), 0.0, 1.0, float(np.log(share / (1 - share))))
    x = [np.asarray(f, np.int64) for f in picked.f]
    y = picked.label.to_numpy()
    held = np.arange(len(x)) % 4 == 0 if min(n) >= 8 else np.zeros(len(x), bool)
    w = descend([f for f, h in zip(x, held) if not h], np.where(y[~held] == 1, 1.0, -1.0), r, cost, epochs, seed)
    model = Model(w[:-1] * r, float(w[-1]), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else np.arange(len(x))
    row = np.repeat(np.arange(len(check)), [len(x[i]) for i in check])
    m = model.margins(row, np.concatenate([x[i] for i in check]), len(check))
    share = np.array([labelled[c] / n[c] for c in (0, 1)])     # the sample takes classes alike, the labels do not
    model.a, model.b = calibrate(m, y[check], (share / share.max())[y[check]])
    return model


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    buckets = len(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices([batch], PART_BYTES):
                row, bucket = features(part.column("text"), buckets)
                s = m.scores(m.margins(row, bucket, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s),
                                                  pa.array((s >= keep).astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10's contract columns."""
    return score(docs, fit(docs, labels)).select("doc_id", (~training_row(4, 2)).alias("held_out"), "score", "predicted")


by_value(common, sys.modules[__name__])
