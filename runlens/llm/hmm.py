"""op3: hidden Markov language model, trained by Baum-Welch over the whole corpus.

* Tokens are lower-cased words, then one end token per document. Their counts over the training documents are summed in
  Spark: tasks emit one row per distinct token of a block of text, so a frequent word costs a row per block.
* A token's symbol is itself if it is one of the ``top`` most frequent, else a class of rare words
  (a hash of the last bytes); inside a class a token has probability ``(c + 0.1) / (N_class + 0.1 * (V_class + 1))``. The state-dependent
  part of the model is over symbols only, so its size is bounded by parameters.
* Baum-Welch: each round, tasks run the scaled forward-backward recursion over their encoded training documents and emit expected start,
  transition and emission counts; Spark sums them across partitions and the driver re-estimates the few parameters. Every text counts
  as one sequence: one over ``LONG`` tokens is cut into parts of ``PIECE``, whose products of step matrices, chained forwards and
  backwards, give the exact state vectors at the cuts, so that the parts can be taken at the same time.
* Scoring: the scaled forward recursion over each whole text gives its exact log10 likelihood under the model. Documents of
  a block advance together; a text over ``LONG`` tokens is cut, each part's product of step matrices is taken at the same time,
  and the products are chained in order, which is the same likelihood.

Defined results: a null or empty text is one end token; a null id counts as training; without training documents the base score
is 0 per token and the model is uniform; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import (
    U64, by_value, lower, mix64, slices, span_hash, stored, text_buffer, training_row, words,
)

STATES = 8
TOP = 4000
CLASSES = 512
ROUNDS = 4
BLOCK_BYTES = 12 << 20
PIECE = 256
LONG = 4096
TOKENS_AT_ONCE = 1 << 19
END = np.int64(-0x1234567)

_HEAD = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("size", pa.int32())])
_RAW = pa.schema([("block", pa.int64()), ("head", pa.binary()), ("codes", pa.binary()), ("local", pa.int32()),
                  ("hash", pa.int64()), ("cls", pa.int16()), ("n", pa.int32())])
RAW = "block long, head binary, codes binary, local int, hash long, cls short, n int"
_ENC = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())),
                  ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("inner", pa.list_(pa.float64())),
                  ("codes", pa.binary())])
ENC = ("ids array<long>, held array<boolean>, size array<int>, known array<int>, base array<double>,"
       "inner array<double>, codes binary")


def packed(codes: np.ndarray, width: int) -> bytes:
    """Numbers below 256 ** width, low bytes first, then the next, compressed (small numbers are frequent)."""
    planes = b"".join((codes >> (8 * k) & 255).astype(np.uint8).tobytes() for k in range(width))
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return sum(planes[k].astype(np.int64) << (8 * k) for k in range(width))


def token_classes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word from its last three bytes."""
    return (span_hash(buf, np.maximum(start, end - 3), end) % U64(classes)).astype(np.int16)


def tokenised(part: pa.RecordBatch, classes: int):
    """(sizes with the end token, token hashes, class of each token) of the rows of a batch."""
    buf, off = text_buffer(part.column("text"))
    buf = lower(buf)
    w = words(buf, off)
    n = np.diff(w.first)
    size = n + 1
    last = np.cumsum(size) - 1
    h = np.full(int(size.sum()), END, np.int64)
    cls = np.full(len(h), -1, np.int16)
    at = np.ones(len(h), bool)
    at[last] = False
    h[at] = w.hash.view(np.int64)
    cls[at] = token_classes(buf, w.start, w.end, classes)
    return size, h, cls


def blocks(docs: DataFrame, classes: int, block_bytes: int) -> DataFrame:
    """Rows of two kinds: a block of encoded documents, and each distinct token of a block with its training count."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~training_row(10, 0)).alias("held"))

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for part in slices(batches, block_bytes):
            size, h, cls = tokenised(part, classes)
            held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
            seen, first, code, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")          # frequent tokens get small codes
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code, seen, first = rank[code], seen[order], first[order]
            n = np.bincount(code[np.repeat(~held, size)], minlength=len(seen)).astype(np.int32)
            head = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held), pa.array(size.astype(np.int32))],
                                              schema=_HEAD)
            one = [pa.array([x], f.type) for x, f in zip((block, head.serialize().to_pybytes(), packed(code, 4)), _RAW)]
            yield pa.RecordBatch.from_arrays(one + [pa.nulls(1, f.type) for f in list(_RAW)[3:]], schema=_RAW)
            m = len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, block)), *[pa.nulls(m, f.type) for f in list(_RAW)[1:3]], pa.array(np.arange(m, dtype=np.int32)),
                 pa.array(seen), pa.array(cls[first]), pa.array(n)], schema=_RAW)
            block += 1

    return docs.mapInArrow(run, RAW)


class Symbols:
    """Corpus totals, the frequent tokens, and the rare classes' totals."""

    def __init__(self, counts: DataFrame, top: int, classes: int):
        t = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
        self.n, self.v = int(t.n or 0), int(t.v or 0)
        frequent = counts.where((F.col("c") > 0) & (F.col("hash") != int(END))).orderBy(F.desc("c"), "hash").limit(top).toPandas()
        self.top = np.sort(np.append(frequent["hash"].to_numpy(np.int64), END))
        top_c = dict(zip(frequent["hash"], frequent["c"]))
        end = counts.where(F.col("hash") == int(END)).first()
        top_c[int(END)] = end.c if end else 0
        rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame(
            [(int(x),) for x in self.top], "hash long")), "hash", "left_anti")     # at most ``top`` + 1 rows
        per = rare.groupBy("cls").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).toPandas()
        self.class_n, self.class_v = np.zeros(classes), np.zeros(classes)
        self.class_n[per.cls], self.class_v[per.cls] = per.n, per.v
        self.count = np.concatenate([[top_c[int(x)] for x in self.top], self.class_n]).astype(float)

    def numbered(self, counts: DataFrame) -> DataFrame:
        """``hash, c, sym``: a frequent token is its own symbol, another the one of its class."""
        known = counts.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(self.top)], "hash long, own int")
        return (counts.join(F.broadcast(known), "hash", "left")                        # at most ``top`` + 1 rows
                .select("hash", "c", F.coalesce("own", F.lit(len(self.top)) + F.col("cls")).cast("int").alias("sym")))


def encode_corpus(docs: DataFrame, top: int, classes: int, block_bytes: int):
    """(encoded blocks, Symbols): per document sizes, base score, within-class score; per block the symbols."""
    raw = stored(blocks(docs, classes, block_bytes), "hmm_blocks")
    tokens = raw.where("hash is not null")
    counts = stored(tokens.groupBy("hash").agg(F.first("cls").alias("cls"), F.sum("n").alias("c")), "hmm_counts")
    symbols = Symbols(counts, top, classes)
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    local = tokens.select("block", "local", "hash").join(symbols.numbered(counts), "hash").select("block", "local", "c", "sym")
    both = (raw.where("codes is not null")
            .select("block", "head", "codes", F.lit(-1).alias("local"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("sym"))
            .unionByName(local.withColumns({"head": F.lit(b""), "codes": F.lit(b"")})))

    def encode_block(row, c, sym):
        s = shared.value
        rare = sym >= len(s.top)
        inner = np.zeros(len(sym))
        k = sym[rare] - len(s.top)
        inner[rare] = np.log10((c[rare] + 0.1) / (s.class_n[k] + 0.1 * (s.class_v[k] + 1)))
        base = np.log10((c + 0.1) / (s.n + 0.1 * (s.v + 1)))
        head = pa.ipc.read_record_batch(row[0], _HEAD)
        size = np.asarray(head.column("size")).astype(np.int64)
        code = unpacked(row[1], int(size.sum()), 4)
        cut = np.concatenate([[0], np.cumsum(size)[:-1]])
        sums = [np.add.reduceat(x[code], cut) for x in ((c > 0).astype(np.int32), base, inner)]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([c], f.type) for c, f in zip(head.columns, _ENC)],
             *[pa.array([x], f.type) for x, f in zip(sums, list(_ENC)[3:6])], pa.array([packed(sym[code], 2)], pa.binary())], schema=_ENC)

    def run(batches):
        row, parts = None, []

        def done():
            return encode_block(row, *(np.concatenate([p[i] for p in parts]) for i in range(2)))

        for b in batches:
            local_id = np.asarray(b.column("local"))
            heads = np.flatnonzero(local_id < 0)
            for i, j in zip(np.append(-1, heads), np.append(heads, b.num_rows)):
                if i >= 0:
                    if row is not None:
                        yield done()
                    row, parts = [pa.py_buffer(b.column(f)[i].as_py()) for f in ("head", "codes")], []
                part = b.slice(i + 1, j - i - 1)
                parts.append([np.asarray(part.column(f)) for f in ("c", "sym")])
        if row is not None:
            yield done()

    one_block = both.repartition("block").sortWithinPartitions("block", "local")
    return stored(one_block.mapInArrow(run, ENC), "hmm_encoded"), symbols


class Params:
    """Start, transition and emission probabilities (emission is kept symbol by state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start = start / start.sum()
        self.move = move / move.sum(axis=1, keepdims=True)
        self.emit = np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T)


def first_params(count: np.ndarray, states: int, seed: int) -> Params:
    """Unigram emissions, bent apart per state by seeded weights; states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (count + 0.1) * rng.exponential(size=(states, len(count)))
    return Params(np.ones(states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit)


def in_step(size: np.ndarray):
    """Order of the sequences by falling length, and how many are still running at every step."""
    order = np.argsort(-size, kind="stable")
    longest = int(size[order[0]]) if len(size) else 0
    return order, len(size) - np.searchsorted(np.sort(size), np.arange(longest), "right")


def posteriors(sym: np.ndarray, start: np.ndarray, size: np.ndarray, p: Params, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Scaled forward-backward over the sequences sym[start : start + size], all in step.

    ``enter`` is each sequence's state distribution before its first token (default: the start probabilities), ``leave`` the backward
    vector at its last (default: ones, nothing follows). Returns each sequence's first state posterior, and the sums of
    expected transitions and emissions.
    """
    s = len(p.start)
    order, running = in_step(size)
    start, steps = start[order], len(running)
    first = p.start if enter is None else enter[order]
    last = np.ones((len(size), s)) if leave is None else leave[order]
    at = np.concatenate([[0], np.cumsum(running)])
    alpha, scale, seen = np.empty((at[-1], s)), np.empty(at[-1]), np.empty(at[-1], np.int64)
    for t in range(steps):
        m = running[t]
        k = sym[start[:m] + t]
        a = (alpha[at[t - 1]:at[t - 1] + m] @ p.move if t else first) * p.emit[k]
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[at[t]:at[t + 1]], scale[at[t]:at[t + 1]], seen[at[t]:at[t + 1]] = a, c, k
    moves = np.zeros((s, s))
    beta = np.ones((0, s))
    for t in range(steps - 1, -1, -1):
        m = running[t]
        full = last[:m].copy()
        if t + 1 < steps:
            n = running[t + 1]
            nxt = slice(at[t + 1], at[t + 2])
            ahead = p.emit[seen[nxt]] * beta / scale[nxt][:, None]
            moves += alpha[at[t]:at[t] + n].T @ ahead
            full[:n] = ahead @ p.move.T
        beta = full
        alpha[at[t]:at[t + 1]] *= beta           # posterior of the states
    emit = np.stack([np.bincount(seen, alpha[:, i], minlength=len(p.emit)) for i in range(s)])
    heads = np.empty((len(size), s))
    heads[order] = alpha[:len(size)]
    return heads, moves * p.move, emit


def expected_counts(sym: np.ndarray, start: np.ndarray, size: np.ndarray, p: Params):
    """Expected start, transition and emission counts of whole sequences."""
    heads, moves, emit = posteriors(sym, start, size, p)
    return heads.sum(axis=0), moves, emit


def pieces(begin: np.ndarray, size: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in its sequence, start, size) of consecutive runs of at most ``longest`` tokens that cover each sequence."""
    n = -(-size // longest)
    seq = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    return k, begin[seq] + k * longest, np.minimum(longest, size[seq] - k * longest)


def at_once(size: np.ndarray):
    """Consecutive groups of about ``TOKENS_AT_ONCE`` tokens."""
    group = np.cumsum(size) // TOKENS_AT_ONCE
    for g in np.unique(group):
        yield np.flatnonzero(group == g)


def cut_counts(sym: np.ndarray, begin: np.ndarray, size: np.ndarray, p: Params):
    """``expected_counts`` of long sequences, cut into parts that are taken in step."""
    k, start, n = pieces(begin, size, PIECE)
    mats = np.concatenate([_forward(sym, start[g], n[g], p, None)[0] for g in at_once(n)])
    enter, end, leave = np.empty((len(n), len(p.start))), np.empty((len(n), len(p.start))), np.ones((len(n), len(p.start)))
    for i in range(len(n)):
        enter[i] = end[i - 1] @ p.move if k[i] else p.start
        x = enter[i] @ mats[i]
        end[i] = x / x.sum()
    for i in np.flatnonzero(k)[::-1]:
        x = p.move @ (mats[i] @ leave[i])
        leave[i - 1] = x / (end[i - 1] @ x)
    heads, total = np.empty_like(enter), None
    for g in at_once(n):
        heads[g], *got = posteriors(sym, start[g], n[g], p, enter[g], leave[g])
        total = got if total is None else [x + y for x, y in zip(total, got)]
    cut = np.flatnonzero(k)
    over = end[cut - 1].T @ (heads[cut] / enter[cut])          # transitions over the cuts
    return heads[k == 0].sum(axis=0), total[0] + over * p.move, total[1]


def corpus_counts(sym: np.ndarray, size: np.ndarray, p: Params):
    """Expected counts, part by part, of the sequences that lie one after the other in ``sym``."""
    begin = np.cumsum(size) - size
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(size[short], kind="stable")]      # sequences of a group end at about the same step
    for g in at_once(size[short]):
        yield expected_counts(sym, begin[short[g]], size[short[g]], p)
    long = np.flatnonzero(size > LONG)
    if len(long):
        yield cut_counts(sym, begin[long], size[long], p)


def baum_welch(encoded: DataFrame, p: Params, states: int) -> Params:
    """One round: expected counts of all training documents, summed across partitions."""
    n_sym = len(p.emit)
    shared = encoded.sparkSession.sparkContext.broadcast(p)
    schema = pa.schema([("cell", pa.int32()), ("x", pa.float64())])

    def run(batches):
        total = None
        for b in batches:
            for r in b.to_pylist():
                size = np.asarray(r["size"], np.int64)
                sym = unpacked(r["codes"], int(size.sum()), 2)
                sym = sym[np.repeat(~np.asarray(r["held"], bool), size)]
                for got in corpus_counts(sym, size[~np.asarray(r["held"], bool)], shared.value):
                    total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            flat = np.concatenate([np.ravel(x) for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], schema=schema)

    sums = (encoded.select("held", "size", "codes").mapInArrow(run, "cell int, x double")
            .groupBy("cell").agg(F.sum("x").alias("x")).toPandas())
    flat = np.zeros(states + states * states + states * n_sym)
    flat[sums.cell] = sums.x
    s2 = states * states
    return Params(flat[:states] + 0.1, flat[states:states + s2].reshape(states, states) + 0.1,
                  flat[states + s2:].reshape(states, n_sym) + 0.01)


def log_likelihood(sym: np.ndarray, size: np.ndarray, p: Params) -> np.ndarray:
    """Exact log10 probability of each symbol sequence (sequences lie one after the other in ``sym``)."""
    out = np.zeros(len(size))
    begin = np.cumsum(size) - size
    for docs, rows in ((np.flatnonzero(size <= LONG), None), (np.flatnonzero(size > LONG), len(p.start))):
        if not len(docs):
            continue
        if rows is None:                         # one state vector per document
            _, ll = _forward(sym, begin[docs], size[docs], p, p.start[None, :])
            out[docs] = ll
            continue
        for d in docs:                           # one matrix per part, chained in order
            _, start, n = pieces(begin[d:d + 1], size[d:d + 1], PIECE)
            mats, logs = _forward(sym, start, n, p, None)
            v, ll = p.start.copy(), 0.0
            for i, (m, lg) in enumerate(zip(mats, logs)):
                v = (v if i == 0 else v @ p.move) @ m
                c = v.sum()
                v, ll = v / c, ll + np.log10(c) + lg
            out[d] = ll
    return out


def _forward(sym, start, size, p: Params, first: np.ndarray | None):
    """(last state rows, log10 scale) of each sequence; ``first`` None starts from every state alone (a matrix)."""
    order, running = in_step(size)
    start = start[order]
    s = len(p.start)
    r = s if first is None else 1
    now = np.broadcast_to(np.eye(s) if first is None else first, (len(size), r, s)).copy()
    log = np.zeros(len(size))
    for t, m in enumerate(running):
        a = now[:m]
        if t:
            a = (a.reshape(-1, s) @ p.move).reshape(m, r, s)
        a = a * p.emit[sym[start[:m] + t]][:, None, :]
        c = a.sum(axis=(1, 2))
        now[:m] = a / c[:, None, None]
        log[:m] += np.log10(c)
    rows, ll = np.empty_like(now), np.empty(len(size))
    rows[order], ll[order] = now, log
    return rows, ll


def train(docs: DataFrame, states: int = STATES, top: int = TOP, classes: int = CLASSES, rounds: int = ROUNDS,
          block_bytes: int = BLOCK_BYTES, seed: int = 3):
    """(encoded corpus, Symbols, Params)."""
    encoded, symbols = encode_corpus(docs, top, classes, block_bytes)
    p = first_params(symbols.count, states, seed)
    for _ in range(rounds):
        p = baum_welch(encoded, p, states)
    return encoded, symbols, p


def score(encoded: DataFrame, symbols: Symbols, p: Params) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(p)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {f: b.column(f)[i].values for f in b.schema.names if f != "codes"}
                size = np.asarray(r["size"], np.int64)
                sym = unpacked(b.column("codes")[i].as_py(), int(size.sum()), 2)
                ll = log_likelihood(sym, size, shared.value) + np.asarray(r["inner"])
                yield pa.RecordBatch.from_arrays(
                    [r["ids"], r["held"], pa.array(size), r["known"].cast(pa.int64()), r["base"], pa.array(ll)], schema=schema)

    return (encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double,"
                                    "score double").withColumn("train_tokens", F.lit(symbols.n).cast("long"))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def report(docs: DataFrame) -> DataFrame:
    """op3's contract columns."""
    return score(*train(docs))


by_value(common, sys.modules[__name__])
