"""op12: alignment of two tokenizers by pointer jumping, and counts of the token pairs that end together.

Per part of a batch the tokens of both tokenizers are byte intervals over the same concatenated texts. Every token points
to the token of the other tokenizer that overlaps it and reaches farthest to the right (it holds the token's last byte);
a token of B whose last byte is also the end of one of A points to itself. All pointers are followed at once,
``next = next[next]``, so after about log2 of the longest chain every token points to the last token of its component,
which labels the group.

Each group's two last tokens are linked. Links are written by document (two dictionary-coded id lists), counted per pair in
one pass (summed per task before the exchange, so a common pair is one row per task), and looked up in a second pass. The counts used
there come by two exact ways: the commonest pairs, at most ``HOT`` by a threshold on the count, as arrays in each worker, and a
join for the links of all rarer pairs.

Defined results: a null or empty text, or one whose joined token bytes differ from a space and the text, has no tokens: zeros
and an empty groups hash. Repeated rows and null ids are rows of their own. An empty table gives an empty result. A text is
tokenised whole, in one task. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import by_value, scratch, slices, stored

PART = 1 << 19          # bytes of text aligned at once
LINKS = 1 << 18         # links counted or looked up at once
HOT = 1 << 20           # most pairs whose counts go to every worker
HELD = 1 << 20          # distinct pairs a task gathers before it passes them on
SHIFT = np.int64(32)

ALIGNED = ("uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "link_a array<int>, link_b array<int>")
SCORED = ("uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "n_best long, count_sum long, rare_a array<int>, rare_b array<int>")
REPORT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_INTS = pa.list_(pa.int32())


def byte_table(entries: list[str]) -> list[bytes]:
    """Bytes of byte-level entries: printable code points stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(back[c] for c in e) if all(c in back for c in e) else e.encode() for e in entries]


def by_rank(vocabulary: dict, entries: list[bytes]) -> bool:
    """Whether a byte-level vocabulary merges pairs in the order of the ids they make, so that a rank tokenizer gives the same ids."""
    model, before = vocabulary["model"], vocabulary["pre_tokenizer"] or {}
    ids = model.get("vocab", {})
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", []))
    return (model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not vocabulary["normalizer"]
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and set(entries[:256]) == {bytes([i]) for i in range(256)}
            and all(ids.get(x + y) == 256 + k for k, (x, y) in enumerate(pairs)))


class Tokenizers:
    """Both tokenizers with the bytes of every id; built once a task from the files' contents.

    A byte-level vocabulary whose merges are numbered by rank is encoded by the rank tokenizer, about four times as fast and with the
    same ids (tests compare them on every code point and entry); any other by the library of its file.
    """

    def __init__(self, a_json: str, b_model: bytes, pattern: str | None):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        a = Tokenizer.from_str(a_json)
        a.encode_special_tokens = True
        self.a_bytes = byte_table([a.id_to_token(i) or "" for i in range(a.get_vocab_size())])
        if pattern and by_rank(json.loads(a_json), self.a_bytes):
            special = {x["id"] for x in json.loads(a_json)["added_tokens"]}
            quick = tiktoken.Encoding("a", pat_str=pattern, special_tokens={},
                                      mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special})
            self.a = quick.encode_ordinary
        else:
            self.a = lambda text: a.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_size, self.b_size = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.ids = max(len(self.a_bytes), len(self.b_bytes))
        self.names = np.array([f"{i}{s}" for s in (",", "|", ";", "") for i in range(self.ids)], object)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers per text; none where the bytes do not come back whole."""
        out = []
        for t, b in zip(texts, self.b.encode(texts, num_threads=1)):
            raw, a = (" " + t).encode(), self.a(" " + t)
            whole = (t and b"".join(map(self.a_bytes.__getitem__, a)) == raw
                     and b"".join(map(self.b_bytes.__getitem__, b)) == raw)
            out.append((a, b) if whole else ([], []))
        return out


def positions(ends: np.ndarray, size: int) -> np.ndarray:
    """For every byte position up to ``size``, how many ends lie before it."""
    out = np.zeros(size + 2, np.int32)
    out[ends + 1] = 1
    return np.cumsum(out, dtype=np.int32)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of A and of B the token of B that ends its component, and of every token of B the one of A that holds its last byte.

    ``a_end`` and ``b_end`` are the ends of tokens without gaps over the same bytes.
    """
    n = len(a_end)
    size = int(a_end[-1]) if n else 0
    to_b, to_a = positions(b_end, size)[a_end], positions(a_end, size)[b_end]
    own = np.arange(n, n + len(b_end), dtype=np.int32)
    nxt = np.concatenate([n + to_b, np.where(a_end[to_a] > b_end, to_a, own)]) if n else np.empty(0, np.int32)
    while True:
        far = nxt[nxt]
        if np.array_equal(far, nxt):
            return nxt[:n] - n, nxt[n:] - n, to_a
        nxt = far


def align(pairs: list[tuple[list[int], list[int]]], t: Tokenizers) -> list[tuple]:
    """Per text: number of tokens of A and B and of groups, the groups as text, ids of A and of B of the links."""
    n_a, n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(p[k] for p in pairs), np.int32, n) for k, n in ((0, n_a.sum()), (1, n_b.sum())))
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    a_last, b_last, to_a = terminals(a_end, b_end)
    ends = b_last == np.arange(len(b), dtype=np.int32)          # tokens of B that end a group
    stop = np.flatnonzero(ends)
    number = np.cumsum(ends, dtype=np.int32) - ends              # groups that end before a token of B
    a_group, b_group = number[a_last], number[b_last]
    a_first, b_first = (np.concatenate([[0], x + 1]).astype(np.int32) for x in (to_a[stop], stop))
    place_a = np.arange(len(a), dtype=np.int32) + b_first[a_group]
    place_b = np.arange(len(b), dtype=np.int32) + a_first[b_group + 1]
    code = np.empty(len(a) + len(b) + 1, np.int32)               # group and side of every token in the order of writing
    code[place_a], code[place_b], code[-1] = 2 * a_group, 2 * b_group + 1, 2 * len(stop)
    ids = np.empty(len(code) - 1, np.int32)
    ids[place_a], ids[place_b] = a, b
    step = code[1:] - code[:-1]
    mark = np.where(step == 0, 0, 2 - code[1:] % 2)              # within a side, to the other side, to the next group
    upto = np.cumsum(n_a + n_b)
    mark[upto[n_a > 0] - 1] = 3
    words = t.names[mark * t.ids + ids].tolist()
    link_a, link_b = a[to_a[stop]], b[stop]
    groups = np.searchsorted(stop, np.cumsum(n_b))               # groups up to the end of every text
    out, w, g = [], 0, 0
    for x, y, end, h in zip(n_a.tolist(), n_b.tolist(), upto.tolist(), groups.tolist()):
        out.append((x, y, h - g, "".join(words[w:end]), link_a[g:h], link_b[g:h]))
        w, g = end, h
    return out


def tokenized(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """One row per document: ``ALIGNED``. The two vocabulary files are read on the driver and broadcast (a few MB each)."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read(), pattern))

    def run(batches):
        t = Tokenizers(*shared.value)
        for part in slices(batches, PART):
            texts = [x or "" for x in part.column("text").to_pylist()]
            rows = align(t.encode(texts), t)
            n_a, n_b, groups, names, link_a, link_b = zip(*rows)
            sizes = np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)
            flat = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(x), pa.int32())) for x in (link_a, link_b)]
            sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in names]
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, groups)),
                 pa.array(sha, pa.string()), *flat],
                names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_a", "link_b"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text")).mapInArrow(run, ALIGNED)


def keys(a, b) -> np.ndarray:
    """One number per pair of ids."""
    a, b = (np.asarray(x, np.int64) for x in (a, b))
    return a << SHIFT | b


def link_slices(batches):
    """Consecutive parts of the batches with about ``LINKS`` links each (a longer row is a part of its own)."""
    for batch in batches:
        if batch.num_rows:
            part = np.cumsum(pc.list_value_length(batch.column("link_a")).to_numpy(zero_copy_only=False)) // LINKS
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1))
            for i, j in zip(cut[:-1], cut[1:]):
                yield batch.slice(i, j - i)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: how many links hold each pair of ids, and whether no pair of the same id of B has more."""
    def count(batches):
        held, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array((held >> SHIFT).astype(np.int32)), pa.array((held & 0xFFFFFFFF).astype(np.int32)),
                                               pa.array(n)], names=["a", "b", "n"])
        for batch in link_slices(batches):
            k, m = np.unique(keys(batch.column("link_a").flatten(), batch.column("link_b").flatten()), return_counts=True)
            at = np.searchsorted(held, k)
            known = held[np.minimum(at, max(len(held) - 1, 0))] == k if len(held) else np.zeros(len(k), bool)
            n[at[known]] += m[known]
            held, n = np.insert(held, at[~known], k[~known]), np.insert(n, at[~known], m[~known])
            if len(held) > HELD:
                yield rows()
                held, n = held[:0], n[:0]
        if len(held):
            yield rows()

    parts = aligned.select("link_a", "link_b").mapInArrow(count, "a int, b int, n long")
    return (parts.groupBy("a", "b").agg(F.sum("n").alias("n"))
            .withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))))


def common_pairs(pairs: DataFrame, most: int):
    """Sorted keys, counts and best marks of the commonest pairs: all with a count of at least the smallest
    power of two that leaves at most ``most`` of them."""
    sizes = dict(pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())   # at most 64 rows
    least, total = 63, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    got = pairs.where(F.col("n") >= F.lit(2 ** least)).toArrow()
    k, n, best = keys(got["a"], got["b"]), got["n"].to_numpy(), np.asarray(got["best"], bool)
    order = np.argsort(k)
    return k[order], n[order], best[order]


def scored(aligned: DataFrame, hot) -> DataFrame:
    """Sums over the links whose pair is among the commonest; the other links are passed on."""
    shared = aligned.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known, n, best = shared.value
        for batch in link_slices(batches):
            lists = [batch.column(c) for c in ("link_a", "link_b")]
            a, b = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))])
            k = keys(a, b)
            at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
            hit = known[at] == k if len(known) else np.zeros(len(k), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(hit, x[at], 0) if len(known) else np.zeros(len(k), np.int64))])
                    for x in (best.astype(np.int64), n)]
            rare = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
                 *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums),
                 *(pa.ListArray.from_arrays(rare, pa.array(x[~hit], pa.int32())) for x in (a, b))],
                names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare_a", "rare_b"])

    return aligned.mapInArrow(run, SCORED)


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, hot: int = HOT) -> DataFrame:
    """One row per document: tokens, groups and links, and the corpus-wide counts of the linked pairs.

    ``pattern`` is the pre-tokeniser's regex of A, if A is byte-level.
    """
    with scratch() as keep:
        aligned = stored(tokenized(docs, a_path, b_path, pattern), "alignment")
        pairs = keep(stored(pair_counts(aligned), "alignment_pairs"))
        done = keep(stored(scored(aligned, common_pairs(pairs, hot)), "alignment_scored"))
    plain = done.where(F.size("rare_a") == 0).select(*REPORT)
    links = done.where(F.size("rare_a") > 0).select("uid", F.explode(F.arrays_zip("rare_a", "rare_b")).alias("x"))
    rest = (links.select("uid", F.col("x.rare_a").alias("a"), F.col("x.rare_b").alias("b")).join(pairs, ["a", "b"])
            .groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("best").cast("long")).alias("more_best")))
    mixed = (done.where(F.size("rare_a") > 0).join(rest, "uid")
             .withColumn("n_best", F.col("n_best") + F.col("more_best"))
             .withColumn("count_sum", F.col("count_sum") + F.col("more")).select(*REPORT))
    return plain.unionByName(mixed)


def report(docs: DataFrame) -> DataFrame:
    """op12's contract columns, with the public byte-level (A) and piece (B) vocabularies."""
    import public_tokenizers
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
                     public_tokenizers.PATTERN)


by_value(common, sys.modules[__name__])
