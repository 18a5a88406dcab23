from collections import Counter

import duckdb
import numpy as np
import pytest

from llm.conftest import SF
from runlens.llm import negatives as N

ROWS = "vec_id long, label int, embedding array<double>"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, n_pos=5, n_neg=10):
    """op13's contract with Python integers."""
    held = []
    for i, label, v in rows:
        if i is None or label is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256.0 * x)) for x in v]))
    out = Counter()
    for i, label, v in held:
        if i % 100:
            continue
        score = [(-sum(p * q for p, q in zip(v, w)), j, other) for j, other, w in held if j != i]
        for s, j, _ in sorted(x for x in score if x[2] == label)[:n_pos]:
            hard = sorted((t, k) for t, k, other in score if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:n_neg]
            out.update((i, j, r, k, -s, -t) for r, (t, k) in enumerate(hard, 1))
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS slot", "'x' AS v", "2 AS uid")
    return df, Counter(map(tuple, N.report(df).select(*COLS).collect()))


def test_sql_on_the_table(spark):
    got = N.report(spark.read.parquet(f"{SF}/embeddings.parquet")).select(*COLS).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({N.REPORT_SQL})").fetchall()
    assert len(want) > 50 and Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("seed,block", [(0, 4096), (1, 37), (2, 5)])
def test_blocks_and_ties(spark, seed, block):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (400, 3)) / 4 + rng.integers(0, 2, (400, 1))     # many equal scores, clustered
    x[100:180] = x[0]                                                          # a common vector
    ids = rng.permutation(1000)[:400] * 5
    labels = np.where(rng.random(400) < 0.4, 3, rng.integers(0, 5, 400))       # a common label
    rows = [(int(i), int(k), v.tolist()) for i, k, v in zip(ids, labels, x)]
    df = spark.createDataFrame([(i, (k + 1) % 10 if i % 7 == 0 else k, v) for i, k, v in rows], ROWS)
    got = Counter(map(tuple, N.mine(df, block=block).select(*COLS).collect()))
    want = brute(rows)
    assert got == want and len(want) > 100


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.5]), (2, 1, [0.0, 0.0]), (3, 2, [1.0, 0.2]), (4, 2, [0.5, 0.0]), (5, 2, [0.0, 1.0]),
            (6, None, [1.0, 1.0]), (8, 2, None), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (11, 2, [None, 1.0]), (12, 2, []),
            (None, 2, [1.0, 1.0]), (13, 2, [0.9, 0.0]), (13, 2, [0.9, 0.0]), (100, 2, [-1.0, 0.0]), (200, 7, [1.0, 1.0]), (7, 0, [0.7, 0.0])]
    _, got = mined(spark, rows)
    assert got == brute(rows) and any(r[4] == 0 == r[5] for r in got)
    assert N.report(spark.createDataFrame([], ROWS)).collect() == []
    assert N.report(spark.createDataFrame([(0, 1, None)], ROWS)).collect() == []


def test_repeated_anchor_rows_and_other_lengths(spark):
    rows = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.5, 0.0, 1.0])]
    _, got = mined(spark, rows)
    assert got == Counter({(100, 1, 1, 2, 65536, 32768): 2})


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100, 1, [2.0 ** 21, 1 / 256]), (1, 1, [2.0 ** 21, 3 / 256]), (2, 2, [2.0 ** 20, 4 / 256]), (3, 2, [2.0 ** 20, 5 / 256]),
            (4, 2, [2.0 ** 20, 4.5 / 256])]
    _, got = mined(spark, rows)
    assert got == brute(rows)
    assert [(r[3], r[5] - 2 ** 57) for r in sorted(got)] == [(3, 5), (2, 4), (4, 4)]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(300, 6)) * 50)
    x[:20] = x[20] * np.arange(1, 21)[:, None]       # angles of exactly 0
    x[40:60] = -x[20]
    x[60] = 0
    theta, norm = N.angles(x, N.directions(x, 8)), N.norms(x)
    low, high = N.bounds(theta, norm, theta, norm)
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 2 * (norm[:, None] * norm).mean()


def test_windows_are_the_whole_numbers_between():
    for p in [*range(-40, 400), 10 ** 18, 9 * 10 ** 18]:
        least, most = N.windows(p)
        assert 30 * p <= 100 * least < 30 * p + 100 and 90 * p - 100 < 100 * most <= 90 * p
