import collections
import itertools
import math
import re
import zlib

import numpy as np

from llm.conftest import EDGES
from runlens.llm import hmm as H


def test_base_counts_and_held_out_gain(docs, texts):
    got = {r.doc_id: r for r in H.report(docs).collect()}
    tok = {i: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None] for i, t in texts}
    train = {i for i in tok if zlib.crc32(str(i).encode()) % 10}
    c = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def naive(sym, p):
    """Sum over all state paths."""
    s = len(p.start)
    total = 0.0
    for path in itertools.product(range(s), repeat=len(sym)):
        x = p.start[path[0]] * p.emit[sym[0], path[0]]
        for a, b, k in zip(path, path[1:], sym[1:]):
            x *= p.move[a, b] * p.emit[k, b]
        total += x
    return math.log10(total)


def test_forward_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    p = H.Params(rng.random(3), rng.random((3, 3)), rng.random((3, 5)))
    size = np.array([1, 7, 4, 6])
    sym = rng.integers(0, 5, size.sum())
    want = [naive(x, p) for x in np.split(sym, np.cumsum(size)[:-1])]
    assert np.allclose(H.log_likelihood(sym, size, p), want)
    monkeypatch.setattr(H, "LONG", 3)
    monkeypatch.setattr(H, "PIECE", 2)
    assert np.allclose(H.log_likelihood(sym, size, p), want)


def test_expected_counts_match_enumeration():
    rng = np.random.default_rng(2)
    p = H.Params(rng.random(2), rng.random((2, 2)), rng.random((2, 3)))
    size = np.array([3, 5])
    sym = rng.integers(0, 3, 8)
    start, move, emit = H.expected_counts(sym, np.array([0, 3]), size, p)
    ws, wm, we = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for x in np.split(sym, [3]):
        weights = []
        for path in itertools.product(range(2), repeat=len(x)):
            q = p.start[path[0]] * p.emit[x[0], path[0]]
            for a, b, k in zip(path, path[1:], x[1:]):
                q *= p.move[a, b] * p.emit[k, b]
            weights.append((path, q))
        z = sum(q for _, q in weights)
        for path, q in weights:
            ws[path[0]] += q / z
            for a, b in zip(path, path[1:]):
                wm[a, b] += q / z
            for s, k in zip(path, x):
                we[s, k] += q / z
    assert np.allclose(start, ws) and np.allclose(move, wm) and np.allclose(emit, we)


def test_cut_texts_count_as_whole_ones(monkeypatch):
    """Texts cut into parts give the counts of whole texts, over the cuts too."""
    rng = np.random.default_rng(4)
    p = H.Params(rng.random(4), rng.random((4, 4)), rng.random((4, 6)))
    size = np.array([1, 9, 2, 700, 3, 4, 33])
    sym = rng.integers(0, 6, size.sum())
    want = H.expected_counts(sym, np.cumsum(size) - size, size, p)
    for longest, piece, tokens in ((3, 2, 5), (1, 1, 64), (8, 256, 1 << 19), (10 ** 6, 2, 7)):
        monkeypatch.setattr(H, "LONG", longest)
        monkeypatch.setattr(H, "PIECE", piece)
        monkeypatch.setattr(H, "TOKENS_AT_ONCE", tokens)
        got = [sum(x) for x in zip(*H.corpus_counts(sym, size, p))]
        assert all(np.allclose(a, b) for a, b in zip(got, want))
    assert np.isclose(want[0].sum(), len(size)) and np.isclose(want[1].sum(), (size - 1).sum())


def test_a_round_equals_plain_baum_welch_over_whole_texts(frame, monkeypatch):
    """The distributed round, with texts cut into parts, against one plain recursion per text; then the scores."""
    monkeypatch.setattr(H, "LONG", 6)
    monkeypatch.setattr(H, "PIECE", 4)
    texts = [(i, " ".join("abcdefgh"[(i * j * j + j) % 8] for j in range(3 + i % 29))) for i in range(60)]
    encoded, symbols, p = H.train(frame(texts), states=3, top=5, classes=2, rounds=2)
    tok = [[w.encode() for w in t.split()] for _, t in texts]
    known = {}
    for r in encoded.collect():
        codes = np.split(H.unpacked(r.codes, sum(r["size"]), 2), np.cumsum(r["size"])[:-1])
        known |= dict(zip(r.ids, codes))
    assert [len(known[i]) for i, _ in texts] == [len(t) + 1 for t in tok]
    q = H.first_params(symbols.count, 3, 3)
    for _ in range(2):
        start, move, emit = 0.1, 0.1, 0.01
        for i, _ in texts:
            if zlib.crc32(str(i).encode()) % 10:
                x = known[i]
                a, b, c = forward_backward(x, q)
                start, move, emit = start + a, move + b, emit + c
        q = H.Params(start, move, emit)
    assert np.allclose(q.start, p.start) and np.allclose(q.move, p.move) and np.allclose(q.emit, p.emit)


def forward_backward(x, p):
    """Unscaled textbook recursion over one short sequence."""
    n, s = len(x), len(p.start)
    f, b = np.zeros((n, s)), np.ones((n, s))
    for t in range(n):
        f[t] = (f[t - 1] @ p.move if t else p.start) * p.emit[x[t]]
    for t in range(n - 2, -1, -1):
        b[t] = p.move @ (p.emit[x[t + 1]] * b[t + 1])
    z = f[-1].sum()
    emit = np.zeros((s, len(p.emit)))
    for t in range(n):
        emit[:, x[t]] += f[t] * b[t] / z
    move = sum((np.outer(f[t], p.emit[x[t + 1]] * b[t + 1]) * p.move / z for t in range(n - 1)), np.zeros((s, s)))
    return f[0] * b[0] / z, move, emit


def test_model_is_a_distribution(frame):
    """Class and symbol probabilities of a tiny model: an unseen word of each class fills the class up to one."""
    encoded, symbols, p = H.train(frame([(i, "aa bb cc aa dd") for i in range(30)]), top=2, classes=4)
    assert np.allclose(p.emit.sum(axis=0), 1) and np.allclose(p.move.sum(axis=1), 1) and np.isclose(p.start.sum(), 1)
    seen = (symbols.class_n + 0.1 * symbols.class_v) / (symbols.class_n + 0.1 * (symbols.class_v + 1))
    assert np.allclose(seen + 0.1 / (symbols.class_n + 0.1 * (symbols.class_v + 1)), 1)


def test_edges(frame, docs):
    rows = H.report(frame(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert H.report(docs.limit(0)).collect() == []
