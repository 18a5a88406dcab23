"""op5: byte-level BPE encoding and decoding by overlapping chunks.

A text of up to ``chunk`` characters is pre-tokenised and encoded where it is read. A longer text is cut into
chunks that overlap by ``overlap`` characters, and the chunks are dealt out over the cluster:

1. every chunk is pre-tokenised from its own start, which may lie inside a pre-token of the text;
2. in the overlap the chunk also scans from the next chunk's start. The first boundary that both scans share is
   where they resynchronise: from there on they agree, because a match depends only on what follows its start.
   Boundaries in the last characters of a cut text are not trusted (a contraction or white space could go on);
3. the chunk's pieces up to that boundary are encoded; the next chunk's pieces before it are cut off when the
   chunks of a text are stitched in order. A text with a pair of chunks that share no boundary (one run longer
   than the overlap) is pre-tokenised again as a whole from its chunks, so the result never depends on the cut.

Every piece is merged by lowest rank on its own, as the vocabulary's tokenizer does; frequent pieces are kept in
a bounded cache. Decoding looks up each id's bytes and concatenates them. Stitching streams: a text's ids are
hashed chunk by chunk. The vocabulary (its file is a parameter) is the only broadcast; its size is that of the
file and does not depend on the data.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows and null ids are encoded
row by row; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import by_value

CHUNK = 1 << 16
OVERLAP = 1 << 10
UNSURE = 4           # characters at a cut whose boundaries may change with what follows
CACHE = 1 << 17      # cached pieces per task
GROUP_BYTES = 1 << 18   # text whose pieces are looked up together (a longer text is a group of its own)
SHORT = 64           # longest piece (bytes) that is cached and merged by scanning

IDS = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"
REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CHUNKS = "uid string, doc_id long, chunk int, n_chunks int, text string"
PARTS = ("uid string, doc_id long, chunk int, n_chunks int, text string, ids binary, sync int,"
         "head array<int>, head_ids array<int>")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank (leftmost first) is merged until none is known."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for pieces of any length."""
    n = len(piece)
    end = list(range(1, n + 1))          # end of the part that starts at i
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = nxt[i]
    return out


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id << 32 | right id) of every pair of tokens that joins to a token, and the joined ids."""
    pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                   if t[:i] in ranks and t[i:] in ranks)
    return np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int64)


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Packed ids of many pieces: one merge per unfinished piece and round, for all pieces at once."""
    keys, values = table
    none = np.int64(1 << 40)
    byte_id = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    sym = byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    of = np.repeat(np.arange(len(pieces)), size)

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], none)

    out = np.empty(len(pieces), object)

    def emit(sym: np.ndarray, of: np.ndarray) -> None:
        packed = sym.astype("<u4").tobytes()
        cut = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for p, i, j in zip(of[cut[:-1]].tolist(), (4 * cut[:-1]).tolist(), (4 * cut[1:]).tolist()):
            out[p] = packed[i:j]

    pair = np.full(len(sym), none)
    if len(keys):
        pair[:-1] = np.where(of[:-1] == of[1:], joined(sym[:-1], sym[1:]), none)
    while len(sym):
        start = np.flatnonzero(np.diff(of, prepend=-1))
        low = np.minimum.reduceat(pair, start)
        count = np.diff(start, append=len(sym))
        done = np.repeat(low == none, count)
        if done.any():
            emit(sym[done], of[done])
            sym, of, pair = sym[~done], of[~done], pair[~done]
            if not len(sym):
                break
            count, low = count[low != none], low[low != none]
        hit = np.flatnonzero(pair == np.repeat(low, count))
        hit = hit[np.diff(of[hit], prepend=-1) != 0]       # leftmost of each piece
        sym[hit] = pair[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))
        sym, of, pair = sym[keep], of[keep], pair[keep]
        pair[hit] = none
        has = hit[hit + 1 < len(sym)]
        has = has[of[has] == of[has + 1]]
        pair[has] = joined(sym[has], sym[has + 1])
        before = hit[hit > 0]
        before = before[of[before - 1] == of[before]]
        pair[before - 1] = joined(sym[before - 1], sym[before])
    return [x if x is not None else b"" for x in out]


class Pieces(dict):
    """Bounded cache: piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray] | None = None):
        super().__init__()
        self.ranks = ranks
        self.table = table

    def learn(self, found: list[list[str]]) -> None:
        """Merge the short pieces that are not cached yet, all at once."""
        new = set().union(*found).difference(self)
        if len(self) + len(new) > CACHE:
            self.clear()
        raw = {p: r for p, r in ((p, p.encode()) for p in new) if len(r) <= SHORT}
        if raw:
            self.update(zip(raw, merge_many(list(raw.values()), self.ranks, self.table)))

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(merge(raw, self.ranks), "<u4").tobytes()
        if len(raw) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def compiled(pattern: str):
    """The pattern with white space as the Unicode property, whatever the regex engine takes ``\\s`` for."""
    import regex
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode(text: str, pat, pieces: Pieces) -> bytes:
    return b"".join(map(pieces.__getitem__, pat.findall(text)))


def decode(ids: bytes, vocab: list[bytes]) -> bytes:
    return b"".join(map(vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for tok, rank in ranks.items():
        out[rank] = tok
    return out


def chunked(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    n = -(-len(text) // chunk)
    for k in range(n):
        yield k, n, text[k * chunk:(k + 1) * chunk + (overlap if k + 1 < n else 0)]


def encode_chunk(text: str, last: bool, pat, pieces: Pieces, chunk: int, overlap: int):
    """(ids up to the sync point, sync offset in the next chunk or -1, head boundaries, id count before each)."""
    found = [(m.start(), m.group()) for m in pat.finditer(text)]
    sync = 0
    if not last:
        trusted = len(text) - UNSURE
        mine = {s for s, _ in found if chunk <= s <= trusted}
        sync = next((m.start() for m in pat.finditer(text, chunk) if m.start() in mine), -1)
    stop = len(text) if last else sync
    head, head_ids, ids, n = [], [], [], 0
    for s, piece in found:
        if s >= stop >= 0:
            break
        if s <= overlap:
            head.append(s)
            head_ids.append(n)
        got = pieces[piece]
        ids.append(got)
        n += len(got) // 4
    if last:   # the end of a short last chunk is a boundary too
        head.append(len(text))
        head_ids.append(n)
    return b"".join(ids), (sync - chunk if sync > 0 else sync if last else -1), head, head_ids


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


_CHUNKS = pa.schema([("uid", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_chunks", pa.int32()),
                     ("text", pa.string())])
_PARTS = pa.schema([*_CHUNKS, ("ids", pa.binary()), ("sync", pa.int32()), ("head", pa.list_(pa.int32())),
                    ("head_ids", pa.list_(pa.int32()))])
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded_sha256", pa.string())])
_REPORT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, digest: bool = False,
                     chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids`` (packed ids; with ``digest`` their hash) and the hash of the decoded bytes."""
    known = read_ranks(vocab_path)
    shared = docs.sparkSession.sparkContext.broadcast((known, merge_table(known)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out_schema = _REPORT if digest else _IDS

    def tools():
        ranks, table = shared.value
        return compiled(pattern), Pieces(ranks, table), vocabulary(ranks)

    def row(doc_id, ids: bytes, vocab):
        return (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest() if digest else ids,
                hashlib.sha256(decode(ids, vocab)).hexdigest())

    def short(batches):
        pat, pieces, vocab = tools()
        for part in common.slices(batches, GROUP_BYTES):
            found = [pat.findall(t) for t in part.column("text").to_pylist()]
            pieces.learn(found)
            yield _batch([row(i, b"".join(map(pieces.__getitem__, f)), vocab)
                          for i, f in zip(part.column("doc_id").to_pylist(), found)], out_schema)

    def cut(batches):
        from pyspark import TaskContext
        task, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                seen += 1
                for k, n, piece in chunked(t.as_py(), chunk, overlap):
                    yield _batch([(f"{task}-{seen}", i, k, n, piece)], _CHUNKS)

    def parts(batches):
        pat, pieces, _ = tools()
        for b in batches:
            for r in b.to_pylist():
                got = encode_chunk(r["text"], r["chunk"] + 1 == r["n_chunks"], pat, pieces, chunk, overlap)
                yield _batch([(r["uid"], r["doc_id"], r["chunk"], r["n_chunks"], r["text"], *got)], _PARTS)

    def stitch(batches):
        pat, pieces, vocab = tools()
        kept = None
        for b in batches:
            for r in b.to_pylist():
                if r["chunk"] == 0:
                    kept = {"sync": 0, "ids": [], "text": [], "n": 0, "sha": hashlib.sha256(),
                            "out": hashlib.sha256()}
                if kept["sync"] >= 0 and kept["sync"] in r["head"]:
                    ids = r["ids"][4 * r["head_ids"][r["head"].index(kept["sync"])]:]
                    kept["n"] += len(ids) // 4
                    kept["out"].update(decode(ids, vocab))
                    if digest:
                        kept["sha"].update(ids)
                    else:
                        kept["ids"].append(ids)
                    kept["sync"] = r["sync"]
                else:
                    kept["sync"] = -1
                last = r["chunk"] + 1 == r["n_chunks"]
                kept["text"].append(r["text"] if last else r["text"][:chunk])
                if not last:
                    continue
                if kept["sync"] < 0:
                    done = row(r["doc_id"], encode("".join(kept["text"]), pat, pieces), vocab)
                else:
                    ids = kept["sha"].hexdigest() if digest else b"".join(kept["ids"])
                    done = r["doc_id"], kept["n"], ids, kept["out"].hexdigest()
                yield _batch([done], out_schema)

    ddl = REPORT if digest else IDS
    long = F.length("text") > chunk
    spread = docs.where(long).mapInArrow(cut, CHUNKS).repartition("uid", "chunk").mapInArrow(parts, PARTS)
    stitched = spread.repartition("uid").sortWithinPartitions("uid", "chunk").mapInArrow(stitch, ddl)
    return docs.where(~long).mapInArrow(short, ddl).unionByName(stitched)


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, text`` back from ``doc_id, ids``."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        vocab = vocabulary(ranks.value)
        for b in batches:
            yield _batch([(i, decode(x or b"", vocab).decode()) for i, x in
                          zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist())], schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    """op5's contract columns, with the public 50k byte-level vocabulary."""
    import public_tokenizers
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


by_value(common, sys.modules[__name__])
