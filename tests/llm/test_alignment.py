import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm.conftest import EDGES
from runlens.llm import alignment as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A_PATH)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
PATTERN = public_tokenizers.PATTERN
VISIBLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BACK = {chr(b): b for b in VISIBLE}
for rest in range(256):
    if rest not in VISIBLE:
        BACK[chr(256 + len(BACK) - len(VISIBLE))] = rest


def spans(texts):
    """(id, end byte) of the tokens of A and of B of a text, or two empty lists."""
    raw = (" " + (texts or "")).encode()
    a = [(i, bytes(BACK[c] for c in TOK.id_to_token(i))) for i in TOK.encode(" " + (texts or ""), add_special_tokens=False).ids]
    b = [(i, bytes([int(SP.id_to_piece(i)[3:5], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("▁", " ").encode())
         for i in SP.encode(texts or "")]
    if not texts or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    out = []
    for side in (a, b):
        end, got = 0, []
        for i, x in side:
            end += len(x)
            got.append((i, end))
        out.append(got)
    return out


def brute(rows):
    """op12's contract for (doc_id, text) rows, straight from its words."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = spans(text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, lo = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if lo < e <= cut) for side in (a, b)))
            lo = cut
        ends = {}
        for i, e in a:
            ends.setdefault(e, []).append(i)
        links = [(i, j) for j, e in b for i in ends.get(e, [])]
        counts.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return Counter((i, x, y, len(g), len(ln), sum(counts[p] == top[p[1]] for p in ln), sum(counts[p] for p in ln),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, g, ln in docs)


ODD = [" ", "  ", "   ", "\n", "\t", "\x00", "\x1c", "\x85", "\xa0", "​", "▁", "'ll", "a", "é", "é", "ß", "中", "文", "½", "ﬁ", "Ａ", "12", "!", "<s>", "</s>", "<unk>", "<0x41>",
       "<|endoftext|>", "\U0001f600", "‍", "the", " the", "ization", " Übergröße", "\r\n", "﻿"]


def test_equals_brute_force(frame):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(400 + i, t) for i, t in enumerate(ODD)] + [(i, t) for i, t, *_ in EDGES]
    for hot, pattern in [(A.HOT, PATTERN), (40, PATTERN), (0, None)]:     # all pairs in the workers, some joined, all joined
        got = Counter(map(tuple, A.alignment(frame(rows), A_PATH, B_PATH, pattern, hot).select(*A.REPORT).collect()))
        assert got == brute(rows)


def test_report_of_the_table(docs, texts):
    got = Counter(map(tuple, A.report(docs).select(*A.REPORT).collect()))
    assert got == brute(texts)
    assert sum(r[1] for r in got) > 10_000


def test_both_libraries_of_a_give_the_same_ids():
    with open(A_PATH, encoding="utf-8") as f, open(B_PATH, "rb") as g:
        t = A.Tokenizers(f.read(), g.read(), PATTERN)
    assert t.a.__name__ == "encode_ordinary"
    texts = [f" a{c}b 1{c}2 !{c}? {c}{c} x" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts += [x.decode() for x in t.a_bytes if x.isascii()] + ["x" * 5000, " " * 5000 + "a", "ab" * 3000]
    for i in range(0, len(texts), 50_000):
        part = texts[i:i + 50_000]
        assert [t.a(x) for x in part] == [e.ids for e in TOK.encode_batch_fast(part, add_special_tokens=False)]


def test_empty_table(spark):
    out = A.report(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == A.REPORT and out.collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_pointers_reach_the_end_of_the_component(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2))
    a_last, b_last, _ = A.terminals(a, b)
    cuts = np.intersect1d(a, b)
    assert (b[a_last] == cuts[np.searchsorted(cuts, a)]).all() and (b[b_last] == cuts[np.searchsorted(cuts, b)]).all()


def test_long_chain():
    a, b = np.append(np.arange(1, 100_000, 2), 100_000), np.append(np.arange(2, 100_000, 2), 100_000)
    a_last, b_last, _ = A.terminals(a, b)
    assert set(a_last) == set(b_last) == {len(b) - 1}


def test_common_pairs_are_bounded(spark):
    pairs = spark.createDataFrame([(a, b, n, n == 9) for a, b, n in [(1, 1, 9), (2, 1, 5), (3, 1, 4), (1, 2, 3), (9, 9, 1)]], "a int, b int, n long, best boolean")
    for most, want in [(10, 5), (4, 4), (3, 3), (2, 1), (1, 1), (0, 0)]:
        k, n, _ = A.common_pairs(pairs, most)
        assert len(k) == want and (np.diff(k) > 0).all()
