"""op2: remove bytes of strings of ``LENGTH`` bytes that start earlier, with suffix arrays by linear grouping.

A string of 100 bytes is owned by one anchor: the 20-byte gram in it with the smallest hash (the leftmost of equals). The choice depends
on the string alone, so equal strings have equal anchors, and each anchor owns one run of consecutive strings of its document. The bytes
these strings cover (180 at most) are the anchor's context.

1. Anchors are found by sliding minima and dealt out by gram. Equal contexts are one: every occurrence but the earliest is covered.
2. Where one gram has several different contexts, these are cut from the texts (only the places are moved before), their suffix arrays are
   built in step (``lyndon.suffix_arrays``), and neighbours in the array that agree on 100 bytes form classes of equal strings. All
   but the earliest of a class are covered. A group of more than ``CONTEXTS`` contexts, such as a passage that thousands
   of documents go on from differently, is not held together: its strings are dealt out by their own content instead.
3. The covered runs of a document meet its text once more, are merged, and cut out.

So suffix arrays are built over what differs between repetitions, and no task holds more than one small group at a time.

Order: documents by id, null ids after all others by content; texts of one id by their hash. Rows equal in id and text are one document:
each gets its result. A null text is empty; texts shorter than 100 bytes keep all bytes; an empty table gives an empty result.
Equal grams, contexts and strings are told by 64-bit hashes of their bytes (two of them together for contexts and dealt-out strings, the
bytes themselves in suffix arrays).
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import common, lyndon
from runlens.llm.common import U64, by_value, few, mix64, prefix_hashes, slices, stored, text_buffer
from runlens.llm.lyndon import ragged, suffix_arrays

LENGTH = 100
GRAM = 20
TEXTS = 1 << 25         # most different texts of one id
CONTEXTS = 64           # most contexts of a gram whose suffix array is built
PART_BYTES = 2 << 20
HELD = 1_500_000        # anchors a task holds before it passes them on
BATCH = 1 << 20         # bytes of contexts whose suffix arrays are built in step

PLACES = "g long, c long, dk long, w long"
_PLACES = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("dk", pa.int64()), ("w", pa.int64())])
FOUND = "kind int, g long, dk long, w long"
_FOUND = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("dk", pa.int64()), ("w", pa.int64())])
CUT = "kind int, g long, c long, dk long, w long, data binary"
_CUT = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("dk", pa.int64()), ("w", pa.int64()),
                  ("data", pa.binary())])
COVERED = "dk long, w long"
_COVERED = pa.schema([("dk", pa.int64()), ("w", pa.int64())])


def pack(lo, width, th):
    """A run of strings of one document: number of the text among those of its id (``TEXTS`` at most), first start (a
    text has under 2^31 bytes), number of strings less one (under 128). Runs of one id are ordered by text, then start."""
    return (th << 38) | (lo << 7) | width


def place_of(w):
    """Text and first start as one number that orders the strings of an id."""
    return w >> 7


def start_of(w):
    return (w >> 7) & 0x7FFFFFFF


def text_of(w):
    return w >> 38


def keyed(docs: DataFrame) -> DataFrame:
    """``dk`` orders documents, ``th`` numbers the different texts of one id by their hash (0 almost always); together they name a
    document. Ids with several texts are found by one aggregate of two hashes per id, and only their rows are numbered."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(text)
    dk: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + h.bitwiseAND(F.lit((1 << 62) - 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), dk.alias("dk"), h.alias("h"), text.alias("text"))
    several = rows.groupBy("dk").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("dk")
    number = F.row_number().over(Window.partitionBy("dk").orderBy("h")) - 1
    fits = F.when(number < TEXTS, number).otherwise(F.raise_error(F.lit(f"an id has more than {TEXTS} different texts")))
    marks = stored(rows.select("dk", "h").join(several, "dk", "left_semi").distinct().withColumn("th", fits.cast("long")), "suffix_texts")
    return (rows.join(few(marks), ["dk", "h"], "left")
            .select("doc_id", "dk", F.coalesce("th", F.lit(0).cast("long")).alias("th"), "text"))


def anchors(buf: np.ndarray, off: np.ndarray):
    """(row, first string, last string, gram hash, context hash) of every anchor; strings relative to their row."""
    none = np.empty(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none, none, none
    s, inv = prefix_hashes(buf)
    n = len(buf) - GRAM + 1
    h = mix64((s[GRAM:] - s[:-GRAM]) * inv[:n])
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    span, d = LENGTH - GRAM + 1, 1
    while 2 * d <= span:
        low = np.minimum(low[:-d], low[d:])
        d *= 2
    if d < span:
        low = np.minimum(low[:len(low) - (span - d)], low[span - d:])
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(at))
    row = np.searchsorted(off, start, "right") - 1
    ok = start + LENGTH <= off[row + 1]
    start, at, row = start[ok], at[ok], row[ok]
    if not len(start):
        return none, none, none, none, none
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    at, row = at[first], row[first]
    c = mix64((s[hi + LENGTH] - s[lo]) * inv[lo] + (at - lo).astype(U64) * U64(0xD6E8FEB86659FD93) + (hi - lo).astype(U64))
    return row, lo - off[row], hi - off[row], h[at].view(np.int64), c.view(np.int64)


def earliest(g, c, dk, w):
    """Sort by (g, c, dk, w); True where (g, c) begins. Rows equal in all four are dropped."""
    o = np.lexsort((w, dk, c, g))
    g, c, dk, w = g[o], c[o], dk[o], w[o]
    same_key = np.zeros(len(g), bool)
    same_key[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] = same_key[1:] & (dk[1:] == dk[:-1]) & (w[1:] == w[:-1])
    keep = ~twice
    return g[keep], c[keep], dk[keep], w[keep], ~same_key[keep]


def places(texts: DataFrame) -> DataFrame:
    """Anchors of all documents. Within a task only the earliest of equal contexts keeps its key; the others are known to
    be covered (``w`` negative) and are dealt out at random."""

    def run(batches):
        held, n = [], 0

        def flush():
            g, c, dk, w, first = earliest(*(np.concatenate(x) for x in zip(*held)))
            spread = mix64((dk * 31 + w).view(U64)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.where(first, g, spread)), pa.array(c), pa.array(dk), pa.array(np.where(first, w, ~w))], schema=_PLACES)

        for part in slices(batches, PART_BYTES):
            row, lo, hi, g, c = anchors(*text_buffer(part.column("text")))
            if not len(row):
                continue
            dk, th = np.asarray(part.column("dk")), np.asarray(part.column("th"))
            held.append((g, c, dk[row], pack(lo, hi - lo, th[row])))
            n += len(row)
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return texts.select("dk", "th", "text").mapInArrow(run, PLACES)


def resolve(batches):
    """Rows sorted by (g, c, dk, w): covered places (kind 0), and those of grams with several contexts (1; 2 if too many)."""
    out: list[tuple] = []
    state = None            # the last gram: its earliest places so far (at most CONTEXTS), or that it has too many

    def put(kind, g, dk, w):
        if len(dk):
            out.append((np.full(len(dk), kind, np.int32), g, dk, w))

    def close():
        if state is not None and not state["many"] and len(state["g"]) > 1:
            put(1, state["g"], state["dk"], state["w"])

    for b in batches:
        g, c, dk, w = (np.asarray(b.column(f)) for f in ("g", "c", "dk", "w"))
        known = w < 0
        put(0, g[known], dk[known], ~w[known])
        g, c, dk, w = g[~known], c[~known], dk[~known], w[~known]
        if not len(g):
            continue
        n_old = 0
        if state is not None:
            if state["g"][-1] != g[0]:
                close()
                state = None
            else:
                g, c, dk, w = (np.concatenate([state[f], x]) for f, x in (("g", g), ("c", c), ("dk", dk), ("w", w)))
                n_old = len(state["g"])
        same = np.zeros(len(g), bool)
        same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
        twice = np.zeros(len(g), bool)
        twice[1:] = same[1:] & (dk[1:] == dk[:-1]) & (w[1:] == w[:-1])
        later = same & ~twice
        put(0, g[later], dk[later], w[later])
        first = np.flatnonzero(~same)
        fg = g[first]
        start = np.flatnonzero(np.diff(fg, prepend=~fg[:1]) != 0)
        count = np.diff(start, append=len(fg))
        was_many = state is not None and state["many"]
        many = np.repeat(count > CONTEXTS, count)
        whole = np.repeat((count > 1) & (count <= CONTEXTS), count)
        last = first >= first[start[-1]]                       # the last gram may go on
        if was_many:
            many[:count[0]] = True
            whole[:count[0]] = False
        fresh = first >= (n_old if was_many else 0)             # places already passed on
        sel = first[many & fresh]
        put(2, g[sel], dk[sel], w[sel])
        sel = first[whole & ~last]
        put(1, g[sel], dk[sel], w[sel])
        keep = first[last]
        too_many = bool(many[-1])
        keep = keep[-1:] if too_many else keep
        state = {"g": g[keep], "c": c[keep], "dk": dk[keep], "w": w[keep], "many": too_many}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_FOUND)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_FOUND)


def cut_out(batches):
    """Contexts (kind 1, with their bytes) and single strings (kind 2) of the places a text is asked for."""
    held, n = [], 0

    def flush():
        g, c, dk, w, first = earliest(*(np.concatenate(x) for x in zip(*held)))
        spread = mix64((dk * 31 + w).view(U64)).view(np.int64)
        m = len(g)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(first, 2, 0).astype(np.int32)), pa.array(np.where(first, g, spread)), pa.array(c), pa.array(dk),
             pa.array(w), pa.nulls(m, pa.binary())], schema=_CUT)

    for b in batches:
        dk_col = np.asarray(b.column("dk"))
        rows = []
        for i in range(b.num_rows):
            buf = np.frombuffer(b.column("text")[i].as_buffer(), np.uint8)
            kind, g, w = (np.asarray(b.column(f)[i].values) for f in ("kinds", "gs", "ws"))
            lo, width = start_of(w), w & 127
            for k in np.flatnonzero(kind == 1):
                rows.append((1, g[k], 0, dk_col[i], w[k], buf[lo[k]:lo[k] + width[k] + LENGTH].tobytes()))
            many = np.flatnonzero(kind == 2)
            if len(many):
                s, inv = prefix_hashes(buf)
                at = ragged(lo[many], width[many] + 1)
                h = mix64((s[at + LENGTH] - s[at]) * inv[at]).view(np.int64)
                held.append((h, np.repeat(g[many], width[many] + 1), np.full(len(at), dk_col[i]),
                             pack(at, 0, text_of(w[many[0]]))))
                n += len(at)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def later_strings(data: list[bytes], group: np.ndarray, dk: np.ndarray, lo: np.ndarray):
    """(context, string) of every string of the contexts that an earlier place of its group also holds.

    ``group`` numbers the contexts' grams in order; the contexts of a gram form one text whose suffix array is built.
    """
    size = np.fromiter(map(len, data), np.int64, len(data))
    buf = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(size)
    last = np.diff(group, append=-1) != 0
    # text of a gram: its contexts, a 1 after each, a 0 at the end
    place = np.repeat(np.arange(len(data)) + np.cumsum(last) - last, size) + np.arange(len(buf))
    total = len(buf) + len(data) + int(last.sum())
    sym = np.ones(total, np.int64)
    sym[place] = buf.astype(np.int64) + 2
    close = np.flatnonzero(last)
    zero = ends[close] + close + 1 + np.arange(len(close))
    sym[zero] = 0
    first = np.concatenate([[0], zero + 1])
    order = suffix_arrays(sym, first)
    of = np.full(total, -1, np.int64)
    of[place] = np.repeat(np.arange(len(data)), size)
    start = np.full(total, -1, np.int64)
    start[place] = np.arange(len(buf)) - np.repeat(ends - size, size)
    ok = (of[order] >= 0) & (start[order] + LENGTH <= size[of[order]])
    pos = order[ok]
    ctx, string = of[pos], start[pos]
    same = np.zeros(len(pos), bool)
    same[1:] = group[ctx[1:]] == group[ctx[:-1]]
    for k in range(0, LENGTH, 8):                              # compare neighbours eight bytes at a time
        k = min(k, LENGTH - 8)
        i = np.flatnonzero(same)
        word = sum((sym[pos[i, None] + np.arange(k, k + 8)] != sym[pos[i - 1, None] + np.arange(k, k + 8)]).T)
        same[i[word > 0]] = False
    cls = np.cumsum(~same)
    rank = np.lexsort((lo[ctx] + string, dk[ctx], cls))
    later = np.zeros(len(pos), bool)
    later[rank[1:]] = cls[rank[1:]] == cls[rank[:-1]]
    return ctx[later], string[later]


def runs(ctx: np.ndarray, string: np.ndarray):
    """(context, first string, number of strings less one) of consecutive strings."""
    o = np.lexsort((string, ctx))
    ctx, string = ctx[o], string[o]
    head = np.ones(len(ctx), bool)
    head[1:] = (ctx[1:] != ctx[:-1]) | (string[1:] != string[:-1] + 1)
    at = np.flatnonzero(head)
    return ctx[at], string[at], np.diff(at, append=len(ctx)) - 1


def solve(batches):
    """Rows sorted by (kind, g, c, dk, w): the covered places of contexts (kind 1) and single strings (kind 2)."""
    waiting: list[tuple] = []
    seen = (None, None, None, None)
    n = 0

    def build(rows):
        g = np.array([r[0] for r in rows])
        group = np.cumsum(np.diff(g, prepend=~g[:1]) != 0)
        dk, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        ctx, lo, width = runs(*later_strings([r[3] for r in rows], group, dk, place_of(w)))
        return pa.RecordBatch.from_arrays(
            [pa.array(dk[ctx]), pa.array(pack(start_of(w[ctx]) + lo, width, text_of(w[ctx])))], schema=_COVERED)

    for b in batches:
        kind = np.asarray(b.column("kind"))
        g, c, dk, w = (np.asarray(b.column(f)) for f in ("g", "c", "dk", "w"))
        known = kind == 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(dk[known]), pa.array(w[known])], schema=_COVERED)
        for i in np.flatnonzero(kind == 1).tolist():
            data = b.column("data")[i].as_py()
            if n >= BATCH and g[i] != waiting[-1][0]:
                yield build(waiting)
                waiting, n = [], 0
            if waiting and (waiting[-1][:3] == (g[i], dk[i], w[i])):
                continue                                       # a repeated row of one document
            waiting.append((g[i], dk[i], w[i], data))
            n += len(data)
        one = kind == 2
        if one.any():
            g, c, dk, w = g[one], c[one], dk[one], w[one]
            same = np.empty(len(g), bool)
            same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            same[0] = seen[:2] == (g[0], c[0])
            twice = np.zeros(len(g), bool)
            twice[1:] = same[1:] & (dk[1:] == dk[:-1]) & (w[1:] == w[:-1])
            twice[0] = seen == (g[0], c[0], dk[0], w[0])
            seen = (g[-1], c[-1], dk[-1], w[-1])
            later = same & ~twice
            yield pa.RecordBatch.from_arrays([pa.array(dk[later]), pa.array(w[later])], schema=_COVERED)
    if waiting:
        yield build(waiting)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_runs(batches):
    """Each text without the bytes its covered runs hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept", pa.binary())])
    for b in batches:
        out = []
        for i in range(b.num_rows):
            data = b.column("text")[i].as_buffer().to_pybytes()
            ws = b.column("ws")[i]
            if not ws.is_valid or not len(ws.values):
                out.append((len(data), 0, 0, data))
                continue
            w = np.asarray(ws.values)
            lo = start_of(w)
            hi = lo + (w & 127) + LENGTH
            o = np.argsort(lo)
            lo, hi = lo[o], np.maximum.accumulate(hi[o])
            head = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
            start, stop = lo[head], hi[np.append(head[1:], len(lo)) - 1]
            at = [0, *np.column_stack([start, stop]).ravel().tolist(), len(data)]
            kept = b"".join(data[x:y] for x, y in zip(at[::2], at[1::2]))
            out.append((len(data), len(data) - len(kept), len(start), kept))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(
            zip(*out) if out else [[]] * 4, list(schema)[1:])]], schema=schema)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    texts = keyed(docs)
    found = stored(places(texts).repartition("g").sortWithinPartitions("g", "c", "dk", "w").mapInArrow(resolve, FOUND), "suffix_found")
    th = F.shiftright("w", 38).alias("th")
    asked = (found.where("kind > 0").groupBy("dk", th).agg(F.collect_list(F.struct("kind", "g", "w")).alias("a"))
             .select("dk", "th", F.col("a.kind").alias("kinds"), F.col("a.g").alias("gs"), F.col("a.w").alias("ws")))
    spread = texts.repartition("dk", "th")                      # one exchange, read by both joins
    cut = spread.join(asked, ["dk", "th"]).select("dk", "text", "kinds", "gs", "ws").mapInArrow(cut_out, CUT)
    covered = (cut.repartition("g").sortWithinPartitions("kind", "g", "c", "dk", "w").mapInArrow(solve, COVERED)
               .unionByName(found.where("kind = 0").select("dk", "w")))
    ranges = covered.groupBy("dk", th).agg(F.collect_list("w").alias("ws"))
    return spread.join(ranges, ["dk", "th"], "left").select("doc_id", "text", "ws").mapInArrow(cut_runs, RESULT)


def report(docs: DataFrame) -> DataFrame:
    """op2's contract columns."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


by_value(common, lyndon, sys.modules[__name__])
