import re
import zlib

import numpy as np
import pyarrow as pa

from llm.conftest import EDGES
from runlens.llm import classifier as C

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in C.report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
               for i, r in got.items())
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in held]) >= 0.95
    assert np.mean([r.predicted for q, r in held if q == 1]) >= 0.94      # some 300 labels are learnt from; texts of two words too


def test_labels_of_held_out_rows_are_not_used(spark, frame):
    docs = frame([(i, "good fine words here" if i % 2 else "bad ### noise !!") for i in range(200)])
    right = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - i % 2) for i in range(200)],
                                    "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in C.report(docs, x).collect()} for x in (right, flipped))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    assert all((s > 0.7) == (i % 2 == 1) for i, s in a.items())


def test_descent_separates():
    x = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w = C.descend(x, y, np.ones(4), 10.0, 50, 0)
    assert all(np.sign(w[f].sum() + w[-1]) == t for f, t in zip(x, y))


def test_edges(spark, frame, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = C.report(frame(EDGES), none).collect()
    assert len(rows) == len(EDGES) and {r.score for r in rows} == {0.5}
    odd = spark.createDataFrame([(4, 1), (4, 0), (5, None), (7, 9), (None, 1), (8, 1)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in C.report(frame(EDGES), odd).collect())
    assert C.report(docs.limit(0), odd).collect() == []


def plain_features(text):
    """Words, shapes, pairs of both, and the marks of repeated words: the distinct n-gram indicators of a text, as Python values."""
    ws = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return ws, {("w", w) for w in ws} | {("2", a, b) for a, b in zip(ws, ws[1:])}


def test_indicators_are_those_of_a_plain_loop():
    texts = ["one two one two", "Two  one\ttwo", "", None, "x", "so so so", "é ü é"]
    row, bucket = C.features(pa.array(texts), 1 << 30)
    assert len(set(zip(row.tolist(), bucket.tolist()))) == len(row)
    got = [set(bucket[row == i].tolist()) for i in range(len(texts))]
    seen = {}
    for i, t in enumerate(texts):                # equal plain indicators have equal buckets; a word's bucket is that of the word alone
        ws, plain = plain_features(t)
        assert bool(got[i]) == bool(ws) and len(got[i]) >= len(plain)
        for w in ws:
            r, b = C.features(pa.array([w.decode()]), 1 << 30)
            assert set(b.tolist()) <= got[i]
            assert seen.setdefault(w, tuple(b.tolist())) == tuple(b.tolist())
    assert {("w", b"two"), ("2", b"two", b"one")} <= plain_features(texts[0])[1] & plain_features(texts[1])[1]
    assert len(got[0] & got[1]) >= 4


def dual_by_gradient(x, y, cost, rounds):
    """The hinge-loss model by projected gradient ascent on its dual, over a dense matrix."""
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(rounds):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, cost)
    return (alpha * y) @ x, alpha, gram


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(7)
    r = rng.normal(size=12)
    lists = [np.sort(rng.choice(12, rng.integers(0, 7), replace=False)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    dense = np.zeros((40, 13))
    for i, f in enumerate(lists):
        dense[i, f], dense[i, 12] = r[f], 1.0
        dense[i] /= np.sqrt(len(f) + 1)
    w, alpha, gram = dual_by_gradient(dense, y, 0.7, 50_000)
    got = C.descend(lists, y, r, 0.7, 3000, 1)
    assert np.allclose(got, w, atol=1e-4)
    primal = 0.5 * got @ got + 0.7 * np.maximum(0, 1 - y * (dense @ got)).sum()
    assert abs(primal - (alpha.sum() - 0.5 * alpha @ gram @ alpha)) < 1e-4


def test_model_and_scores_equal_brute_force(spark, frame):
    """Ratios over all labelled training rows, the optimum over them, margins and scores, against dense matrices."""
    rng = np.random.default_rng(8)
    good, bad = ["clear", "fine", "text", "well", "said"], ["###", "buy", "now", "text", "!!"]
    texts = [(i, " ".join(rng.choice(good if i % 2 else bad, rng.integers(1, 9)))) for i in range(120)] + [(500, ""), (501, None)]
    quality = {i: int(i % 2) for i, _ in texts}
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    docs, buckets, cost = frame(texts), 4096, 0.5
    model = C.fit(docs, labels, sample=1000, buckets=buckets, min_docs=2, cost=cost, epochs=2000)
    train = sorted((h, i) for h, i in ((r.h, r.doc_id) for r in docs.selectExpr("doc_id", "xxhash64(10, doc_id) AS h").collect())
                   if zlib.crc32(str(i).encode()) % 4 != 2)
    one = np.zeros((max(quality) + 1, buckets))
    for i, t in texts:
        one[i, C.features(pa.array([t], pa.string()), buckets)[1]] = 1
    p, q = (one[[i for _, i in train if quality[i] == c]].sum(axis=0) for c in (1, 0))
    r = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    r[p + q < 2] = 0
    size = np.sqrt(one.sum(axis=1, keepdims=True) + 1)
    x = np.column_stack([one * r, np.ones(len(one))]) / size
    assert not model.weights[r == 0].any()
    # A quarter of the rows is kept for the curve; which one depends on the order of the sample, so the optimum is checked by its conditions.
    w = np.append(np.divide(model.weights, r, out=np.zeros(buckets), where=r != 0), model.bias)
    margin = x @ w
    got = {s.doc_id: s.score for s in C.score(docs, model).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-(model.a * margin[i] + model.b)))) < 1e-5 for i, _ in texts)
    order = [i for c in (0, 1) for _, i in sorted((h, i) for h, i in train if quality[i] == c)]
    fitted = np.array([i for k, i in enumerate(order) if k % 4])
    best, _, _ = dual_by_gradient(x[fitted], np.array([1.0 if quality[i] else -1.0 for i in fitted]), cost, 30_000)
    assert np.allclose(x @ best, margin, atol=2e-2)
