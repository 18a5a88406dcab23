import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm.conftest import EDGES
from runlens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
ENC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = [" ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "'", "'ll", "'s", "ve", "a", "é", "ß", "中", "²", "½", "1", "23", "!", "#",
            "_", "\U0001f600", "́", "aaaa", "the", " the"]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_and_merges_equal_the_library():
    rng, pat, pieces = random.Random(1), bpe.compiled(PATTERN), bpe.Pieces(RANKS, bpe.merge_table(RANKS))
    for _ in range(1500):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        found = pat.findall(s)
        pieces.learn([found])
        assert ids(b"".join(map(pieces.__getitem__, found))) == ENC.encode_ordinary(s)
    s = "a" * 20_000 + "b1" * 500
    assert ids(bpe.encode(s, pat, pieces)) == ENC.encode_ordinary(s)


def expected(i, t):
    got = np.array(ENC.encode_ordinary(t or ""), "<u4").tobytes()
    return i, len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_documents(frame, texts):
    rows = texts + [(None if i is None else 10_000 + i, t) for i, t in EDGES]
    got = Counter(map(tuple, bpe.report(frame(rows)).collect()))
    assert got == Counter(expected(i, t) for i, t in rows)


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (64, 30)])
def test_chunks_are_stitched(frame, texts, chunk, overlap):
    rng = random.Random(3)
    rows = [(i, (t or "")[:1500]) for i, t in texts[:40]]
    rows += [(1000 + k, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(30, 400)))) for k in range(80)]
    rows += [(2000, "x" * 500), (2001, "don't " * 60), (2002, " " * 300 + "a"), (2001, "don't " * 60)]
    got = bpe.encode_documents(frame(rows), PATH, PATTERN, digest=True, chunk=chunk, overlap=overlap)
    assert Counter(map(tuple, got.collect())) == Counter(expected(i, t) for i, t in rows)


def test_round_trip(frame):
    rows = [(1, "A text, with ünïcode \U0001f600."), (2, ""), (3, "y" * 200 + " z")]
    enc = bpe.encode_documents(frame(rows), PATH, PATTERN, chunk=50, overlap=8)
    assert sorted(map(tuple, bpe.decode_documents(enc, PATH).collect())) == rows


def test_empty_table(docs):
    assert bpe.report(docs.limit(0)).collect() == []


def test_pieces_are_looked_up_in_groups_of_bounded_bytes(frame, monkeypatch):
    rng, learn = random.Random(5), bpe.Pieces.learn
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(800))) for i in range(400)]

    def watched(self, found):
        assert sum(len(p) for f in found for p in f) <= (1 << 18) + 5000, "a group is too large"
        learn(self, found)

    monkeypatch.setattr(bpe.Pieces, "learn", watched)
    got = Counter(map(tuple, bpe.report(frame(rows).coalesce(1)).collect()))
    assert got == Counter(expected(i, t) for i, t in rows)
