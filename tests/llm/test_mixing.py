from collections import defaultdict

import numpy as np

from llm.conftest import EDGES
from runlens.llm import mixing as M


def water_fill(size, weight):
    """Targets by sharing, capping and sharing again."""
    target, open_ = {s: 0.0 for s in size}, set(size)
    left = float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * size[s] + 1e-9}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, longest_matters=True):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for source, n, source_size, t, took in rows:
        size[source] += n
        taken[source] += took
        target[source] = t
        assert 0 <= took <= 3 * n and (n == 0 or took % n == 0)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    want = water_fill(size, weight)
    for source, n, source_size, t, took in rows:
        assert source_size == size[source] and abs(t - want[source]) < 1e-6 * max(1, want[source])
    return taken, target


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target = check([(r.source, r["size"], r.source_size, r.target, r.taken) for r in rows])
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    again = {(r.doc_id, r.taken) for r in M.report(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_repeats_rows_as_reported(frame):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}" if i % 4 else None) for i in range(1, 120)]
    df = frame(rows)
    out = M.mix(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert got == {r.doc_id: r.taken for r in M.report(df).collect() if r.taken}


def test_small_sources_are_capped(frame):
    rows = [(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "b " * 1000, "b"), (4, None, "c"), (5, "", None)]
    got = {r.doc_id: r for r in M.report(frame(rows)).collect()}
    assert got[1].target == 30 and got[1].taken == 30 and got[4].target == got[4].taken == 0 and got[5].target == 0
    assert abs(got[2].target - 1980) < 1e-6


def test_fit_budget():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sizes = np.unique(rng.integers(0, 40, rng.integers(1, 12)))
        counts = rng.integers(1, 9, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 20))
        take = M.fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * sizes).sum())
        assert got <= budget or got == 0
        if budget <= (sizes * counts).sum():
            assert budget - got <= sizes.max()
    assert (M.fit_budget(np.array([1, 50]), np.array([100, 5]), 123) * np.array([1, 50])).sum() == 123


def test_edges(frame, docs):
    rows = M.report(frame(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert M.report(docs.limit(0)).collect() == []
    assert M.mix(docs.limit(0)).collect() == []


def test_equal_rows_meet_the_target_too(frame):
    """200 rows equal in id and text: just as many are taken as the target asks."""
    rows = [(None, "one two three four five six seven eight", "b")] * 200 + [(k, "w " * 16, "a") for k in range(40)]
    got = M.report(frame(rows)).collect()
    for source in (200 * 8, 40 * 16):
        mine = [r for r in got if r.source_size == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken <= 3 * r.size for r in mine)
    df = frame(rows)
    assert M.mix(df).count() == sum(r.taken // r.size for r in got)
