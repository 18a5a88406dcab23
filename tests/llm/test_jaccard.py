import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import EDGES
from runlens.llm import jaccard as J


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset([tuple(w[k:k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(rows):
    """{doc_id: (set size, smallest id reachable)} by an inverted index and union-find."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    index = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for g in s for j in index[g])
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n, words=60, start=1000, spread=6):
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randint(0, spread)):
            t[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append((start + k, " ".join(t)))
    return out


@pytest.mark.parametrize("small", [2, 64])
def test_against_brute_force(frame, texts, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    rng = random.Random(8)
    line = "one very common line that many short documents share with each other word for word"
    rows = texts + near_copies(rng, 60) + near_copies(rng, 25, 12, 2000, 2) + [(3000 + k, line + f" u{k}" * (k % 4)) for k in range(30)]
    rows += [(4000, "A b C d"), (4001, "a B c D"), (4002, "a b c"), (4003, ""), (4004, None), (4005, "a b c d e"), (4006, "a b c d e a b c d e")]
    want = brute(rows)
    got = {r.doc_id: tuple(r)[1:] for r in J.join(frame(rows)).collect()}
    assert got == want


def test_keep_first(frame):
    rng = random.Random(3)
    rows = near_copies(rng, 12, spread=2) + [(5, "only one of its kind in here at all"), (6, ""), (7, None), (None, "no id"), (5, "another text with an id that is used twice"),
                                             (8, "twice the same row of words"), (8, "twice the same row of words")]
    df = frame(rows)
    out = J.keep_first(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    comps = brute(near_copies(random.Random(3), 12, spread=2))
    first = {c for _, c in comps.values()}
    assert {i for i, _ in got if i is not None and i >= 1000} == first
    assert all(n == 1 for n in got.values()) and len(got) == len(first) + 6


def test_edges(frame, docs):
    rows = [tuple(r) for r in J.join(frame(EDGES)).collect()]
    assert len(rows) == len(EDGES)
    by = {r[0]: r[1:] for r in rows}
    assert by[1] == (0, 1) and by[3] == (0, 3) and by[None][1] is None and by[5][1] == by[6][1] == 5 and by[9] == (7, 9)
    assert J.join(docs.limit(0)).collect() == []


def test_sql_against_brute_force(spark, docs, texts):
    import duckdb
    from llm.conftest import SF
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {r[0]: r[1:] for r in con.sql(J.JOIN_SQL).fetchall()}
    assert got == brute(texts) == {r.doc_id: tuple(r)[1:] for r in J.join(docs).collect()}


def test_tiles_find_what_may_link(monkeypatch):
    """Pairs of different components whose sketches allow a link, across batches and blocks, and no others."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for s in range(6):
        base = rng.integers(0, 1 << 62, 80, dtype=np.int64).astype(np.uint64)
        for k in range(20):
            u = base.copy()
            u[rng.permutation(80)[:rng.integers(0, 30)]] = rng.integers(0, 1 << 62)
            sets[s * 100 + k] = np.unique(u)
        comp = {k: s * 100 + (k if k > 8 else 0) for k in range(20)}
        for block in range(2):
            side = [k for k in range(20) if k > 8 and k % 2 == block]
            rows += [(s, block, 0, s * 100 + k, comp[k], s * 100) for k in side] + [(s, block, 1, s * 100 + k, comp[k], s * 100) for k in range(20)]
    names = ["s", "block", "kind", "x", "c", "main"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    data = [(sets[r[3]] >> np.uint64(48)).astype(np.uint16).tobytes() for r in rows]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] + [pa.array(data, pa.binary())], names=[*names, "data"])
    for size, hits in ((len(rows), J.TILE_HITS), (len(rows), 50), (7, 200), (1, 1)):
        monkeypatch.setattr(J, "TILE_HITS", hits)
        got = set()
        for b in J.near_pairs(whole.slice(i, size) for i in range(0, len(rows), size)):
            got |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
        label = {r[3]: r[4] for r in rows}
        links = {(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and label[a] != label[b]
                 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
        assert links and links <= got and len(got) <= 1.2 * len(links) + 5


def test_scratch_folders_go_and_results_stay(spark, frame, tmp_path):
    from runlens.llm.common import scratch, stored
    from runlens.session import shared_dir
    import pathlib
    root = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = {p for p in root.glob("runlens/jaccard_*/*")}
    words = [f"w{k} " * 3 for k in range(400)]
    df = frame([(k, "".join(words[k % 7:k % 7 + 60])) for k in range(60)])
    rows = J.join(df).collect()
    left = {p for p in root.glob("runlens/jaccard_*/*")} - before
    assert len(rows) == 60 and len(left) == 1                     # the classes that the result is read from
    with scratch() as keep:
        with scratch() as inner:
            a = inner(stored(spark.range(5), "t"))
            b = stored(spark.range(6), "t")
        assert a.count() == 5 and not pathlib.Path(b.stored_at[0].removeprefix("file://")).exists()
        keep(a)
    assert a.count() == 5


def test_splits_go_on_and_stay_exact(frame, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "TILE", 2)
    rng = random.Random(12)
    base = [f"a{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = f"b{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(56)} for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r.component_id for r in J.join(frame(rows)).collect()}
    assert got == comp and 3 < len(set(comp.values())) < 60


def test_packed_replicas_and_sketches_come_back():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 255, 256, 257, 3000, 70_000]:
        for u in (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)), np.arange(n, dtype=np.uint64), ~np.arange(n, dtype=np.uint64)[::-1]):
            data = J.pack_bits(u)
            assert np.array_equal(J.unpack_bits(data), (u >> np.uint64(48)).astype(np.uint16))
            assert len(data) == len(u) + 32 + -(-len(u) // 8)
    s = rng.integers(0, 300, 4000).astype(np.uint64)
    x, z = rng.integers(-1 << 63, 1 << 63, 4000), rng.integers(1, 1 << 30, 4000).astype(np.int32)
    halves = [J.packed(s[i:i + 2000], x[i:i + 2000], z[i:i + 2000]) for i in (0, 2000)]
    data = defaultdict(list)
    for bucket, blobs in halves:
        for k, d in zip(bucket.tolist(), blobs):
            data[k].append(d)
    assert sum(len(d) for ds in data.values() for d in ds) == 16 * 4000          # no more than 16 bytes a replica are dealt out
    groups = defaultdict(set)
    for k, ds in data.items():
        for g, a, b in zip(*(c.tolist() for c in J.unpacked(k, ds))):
            groups[g].add((a, b))
    want = defaultdict(set)
    for g, a, b in zip(s.tolist(), x.tolist(), z.tolist()):
        want[g].add((a, b))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_a_blocks_points_are_sent_once_and_pass_it(size):
    """Every two side points of a region meet once, and each meets every point of the largest component."""
    import pyarrow as pa
    rng = np.random.default_rng(6)
    u = np.unique(rng.integers(0, 1 << 64, 50, dtype=np.uint64))
    rows, want = [], set()
    for s in range(3):
        ids = [s * 100 + k for k in range(30)]
        side, main = ids[:20], ids[20:]
        rows += [(s, b, int(b < k // 7), x, x, main[0]) for k, x in enumerate(side) for b in range(k // 7 + 1)]
        rows += [(s, b, 1, x, main[0], main[0]) for x in main for b in range(3)]
        want |= {(a, b) for a in side for b in side if a < b} | {(a, b) for a in side for b in main}
    rows.sort(key=lambda r: r[:3])
    assert sum(r[2] == 0 for r in rows) == 60
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows), [J.pack_bits(u)] * len(rows)], types)],
                                       names=["s", "block", "kind", "x", "c", "main", "data"])
    got = [p for b in J.near_pairs(J.tile_rows(batch.slice(i, size) for i in range(0, len(rows), size)))
           for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    assert set(got) == want and len(got) == len(want)


def test_python_is_handed_small_batches(spark, frame, monkeypatch):
    key, given = "spark.sql.execution.arrow.maxBytesPerBatch", J.slices
    monkeypatch.setattr(J.common, "BATCH_BYTES", 1 << 16)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(200))) for i in range(200)]
    before = spark.conf.get(key)

    def watched(batches, max_bytes, column="text"):
        def each():
            for b in batches:
                assert b.nbytes <= 1 << 17, "a batch is too large"
                yield b
        yield from given(each(), max_bytes, column)

    monkeypatch.setattr(J, "slices", watched)
    got = {r.doc_id: tuple(r)[1:] for r in J.join(frame(rows).coalesce(1)).collect()}
    assert got == {i: (196, i) for i, _ in rows}
    assert spark.conf.get(key) == before


def test_memory_of_a_part_and_a_tile():
    """Peaks of the arrays that a task makes at once: text cut into parts, and a tile in which every value meets."""
    words = " ".join(f"w{k % 9973}" for k in range(800))
    batch = pa.RecordBatch.from_pydict({"text": [words] * 1000})
    v = np.arange(150, dtype=np.uint16)

    def rows(kind, n):
        i, x = np.zeros(n, np.int64), np.arange(n, dtype=np.int64) + 1000 * kind
        return pa.RecordBatch.from_pydict({"s": i, "block": i, "kind": i.astype(np.int32) + kind, "x": x, "c": x, "main": i - 1,
                                           "data": [v.tobytes()] * n})

    def peak(work):
        tracemalloc.start()
        for _ in work():
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    parts = peak(lambda: (None for part in J.slices([batch], J.PART_BYTES) for _ in J.shingle_sets(part, 5)))
    tiles = peak(lambda: J.near_pairs([rows(0, 500), rows(1, 250)]))
    assert parts < 40 and tiles < 40, (parts, tiles)
