import numpy as np
import pytest

from runlens.llm import ann as A

ROWS = "vec_id long, embedding array<float>"


def brute(ids, x, queries, n=5):
    x = x.astype(np.float32).astype(float)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in queries:
        s = u @ u[ids.index(q)]
        best = sorted((-round(float(c), 12), i) for c, i in zip(s, ids) if i != q)[:n]
        out[q] = [i for _, i in best]
    return out


def test_exact_when_all_cells_are_visited(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[50:80] = x[0]                                  # a common vector: ties go to the smaller id
    ids = list(range(0, 3000, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], ROWS).selectExpr("*", "1 AS cell", "2 AS v")
    got = A.search(df, df.where("vec_id % 50 = 0"), k=4, visit=1.0, block=64).collect()
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == want and {r.rank for r in got} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    got = {}
    for r in A.report(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        a, b = x[ids.index(r.query_id)].astype(float), x[ids.index(r.vec_id)].astype(float)
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert set(got) == set(want)
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]),
            (None, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (50, [3.0, 0.0]), (9, [])]
    got = {}
    for r in A.report(spark.createDataFrame(rows, ROWS)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 1), (2, 50), (3, 8), (4, 8)], 50: [(1, 0), (2, 1), (3, 8), (4, 8)]}
    assert A.report(spark.createDataFrame([], ROWS)).collect() == []


def test_walk_takes_pairs_in_order():
    rng = np.random.default_rng(3)
    left, right = rng.random(6), rng.random(5)
    cells = A.walk(left, right, {c: 1 for c in range(30)}, 30)
    sums = [left[c // 5] + right[c % 5] for c in cells]
    assert len(cells) == 30 and sums == sorted(sums)


def test_the_measured_share_finds_the_target_and_falls_where_rows_cluster():
    """Close clusters need a small share; rows without structure need a large one. Either way the walk finds the target."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    close, loose = centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 16)), rng.normal(size=(2000, 16))
    share = {}
    for name, x in (("close", A.unit(close)), ("loose", A.unit(loose))):
        c0, c1 = A.codebook(x[:, :8], 8, 10, 1), A.codebook(x[:, 8:], 8, 10, 2)
        share[name] = A.needed_share(x, c0, c1, 5, 0.9, 200)
        cell = A.distances(x[:, :8], c0).argmin(axis=1) * len(c1) + A.distances(x[:, 8:], c1).argmin(axis=1)
        count = dict(zip(*np.unique(cell, return_counts=True)))
        found = []
        for i in range(200):
            near = x @ x[i]
            near[i] = -2
            seen = set(A.walk(A.distances(x[i:i + 1, :8], c0)[0], A.distances(x[i:i + 1, 8:], c1)[0], count, share[name] * len(x)))
            found += [c in seen for c in cell[np.argsort(-near)[:5]]]
        assert np.mean(found) >= 0.9
    assert share["close"] < share["loose"] / 2
    assert A.needed_share(A.unit(loose[:1]), c0, c1, 5) == 1.0
