import hashlib
import random

import numpy as np
import pytest

from llm.conftest import EDGES
from runlens.llm import suffix_dedup as S
from runlens.llm.lyndon import suffix_arrays


def test_suffix_arrays_of_many_strings():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [rng.integers(1, 1 + rng.integers(1, 5), rng.integers(0, 40)).tolist() + [0] for _ in range(rng.integers(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        got = suffix_arrays(np.concatenate(strings), first)
        for s, a, b in zip(strings, first[:-1], first[1:]):
            assert (got[a:b] - a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length=100):
    """Result per (id, text) in id order."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                hit[k:k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out[i, t] = (len(b), sum(hit), len(bytes(hit).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("contexts", [2, 64])
def test_against_brute_force(frame, texts, monkeypatch, contexts):
    monkeypatch.setattr(S, "CONTEXTS", contexts)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    made = [(10_000 + k, " ".join(rng.choice(words) for _ in range(40)) + " " + passage[rng.randrange(30):] + " "
             + " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(150)]
    made += [(20_000, "ab" * 400), (20_001, "a" * 5000), (20_002, "Straße éè " * 60), (20_003, "ab" * 300)]
    rows = texts[:60] + made
    want = brute(rows)
    got = {r.doc_id: tuple(r)[1:] for r in S.report(frame(rows)).collect()}
    assert {i: got[i] for i, _ in rows} == {i: want[i, t] for i, t in rows}


def test_edges(frame):
    rows = S.report(frame(EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert by[1] == by[2] == {(0, 0, 0, hashlib.sha256(b"").hexdigest())}
    n = len("same text " * 30)
    assert {x[0] for x in by[5]} == {n} and all(x[1] > 0 for x in by[5])          # repeats itself every 10 bytes
    assert len(by[6]) == 1 and next(iter(by[6]))[:3] == (n, n, 1)                  # equal rows: one document, one result
    assert next(iter(by[7]))[1] == 50_000 - 1          # every string but the first starts earlier too


def test_empty_table(docs):
    assert S.report(docs.limit(0)).collect() == []


def test_texts_of_one_id_do_not_share_their_runs(frame):
    """Many different texts under one id, some that repeat others in part: each loses its own bytes only."""
    rng = random.Random(9)
    words = [f"v{k}x" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    lone = " ".join(rng.choice(words) for _ in range(90))
    many = [(7, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + (" " + passage if k % 3 == 0 else "")) for k in range(200)]
    got = {}
    for r in S.report(frame([(3, passage + " tail"), (7, lone), *many])).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    n = sum(passage in t for _, t in many)
    assert sum(r[1] > 0 for r in got[7]) == n and got[3][0][1] == 0
    whole = sorted((len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for _, t in [(7, lone), *many] if passage not in t)
    assert sorted(r for r in got[7] if not r[1]) == whole


def test_numbers_of_a_place_come_back():
    for lo, width, th in [(0, 0, 0), (2 ** 31 - 1, 127, 2 ** 25 - 1), (12345, 3, 9)]:
        w = S.pack(np.int64(lo), np.int64(width), np.int64(th))
        assert w >= 0 and (S.start_of(w), w & 127, S.text_of(w)) == (lo, width, th)
    assert S.pack(5, 0, 1) > S.pack(2 ** 31 - 1, 127, 0)
