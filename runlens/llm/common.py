"""Helpers shared by the text operators: table access and a vectorised tokeniser.

The tokeniser works on the UTF-8 buffers of an Arrow string column, so no
Python object is made per word. Words are maximal runs of bytes that are
not ASCII white space (``0x20``, ``0x09``-``0x0D``), letters A-Z are lower-cased,
and every word gets a 64-bit hash of its bytes. Two different words share a
hash with probability about 2**-64 per pair.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch_path

WORD = "[^ \\t-\\r]+"
U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[dict[str, DataFrame]] = []


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to a new folder of the shared checkpoint folder and read back. A ``scratch`` block around it deletes the folder."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = [path]
    if _SCOPES:
        _SCOPES[-1][path] = out
    return out


@contextmanager
def scratch():
    """Folders written inside are deleted at the end, but for those of the tables given to the yielded function, which the next
    block outside takes over. Whatever reads a folder must have been written (``stored``) before its block ends."""
    mine: dict[str, DataFrame] = {}
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.extend(table.stored_at)
        return table

    _SCOPES.append(mine)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path, table in mine.items():
            if path in kept:
                if _SCOPES:
                    _SCOPES[-1][path] = table
            else:
                _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:    # a remote session has none: its folders stay until the shared folder is cleared
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


BATCH_BYTES = 4 << 20    # rows that Python is handed together in jobs under ``small_batches``
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run inside hand Python about ``BATCH_BYTES`` of rows at once (a longer row alone), so neither side holds more; the
    session's own setting is put back at the end."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


FEW = 1 << 18           # most rows of ids or short strings that are broadcast


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (written before, a few numbers or a short list each) marked for broadcast if they are counted to be at most ``FEW``."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def training_row(mod: int, rest: int):
    """crc32(doc_id as text) mod ``mod`` is not ``rest``; a null id counts as training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != rest, F.lit(True))


def let(value, body):
    """Bind ``value`` once for use in ``body`` (a lambda), inside one projection."""
    return F.transform(F.array(value), body)[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wraps around)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    while done < n:
        step = U64(pow(base, done, 1 << 64))
        k = min(done, n - done)
        out[done:done + k] = out[:k] * step
        done += k
    return out


_INV = pow(_BASE, -1, 1 << 64)
_POW = np.empty(0, U64)
_INVPOW = np.empty(0, U64)
_BYTE = mix64(np.arange(1, 257, dtype=U64))


def _tables(n: int) -> None:
    global _POW, _INVPOW
    if len(_POW) < n:
        _POW, _INVPOW = _powers(_BASE, n), _powers(_INV, n)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        col = pc.fill_null(col, b"").cast(pa.large_binary())
    else:
        col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, max_bytes: int, column: str = "text"):
    """Consecutive parts of the batches with about ``max_bytes`` of text each (a longer row is a part of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // max_bytes
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1))
        for i, j in zip(cut[:-1], cut[1:]):
            yield batch.slice(i, j - i)


@dataclass
class Words:
    """Words of a batch in text order: byte range, row, and hash of the lower-cased bytes."""
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray   # per row: index of its first word (n_rows + 1)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes kept."""
    return buf + ((buf - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of every row; ``buf`` must already be lower-cased if case is to be ignored."""
    n = len(buf)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not((buf == 32) | ((buf - np.uint8(9)) < 5), out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    joined = cut[inside[cut] & inside[cut + 1]]   # words that touch across a row border
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    start, end = at[0::2], at[1::2]
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(start, end, row, span_hash(buf, start, end), first)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (ranges sorted by start, not overlapping)."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(int(np.searchsorted(end, lo + _PIECE, "right")), i + 1)
        hi = int(end[j - 1])
        _tables(hi - lo + 1)
        s = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[buf[lo:hi]] * _POW[:hi - lo], out=s[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (s[b] - s[a]) * _INVPOW[a]
        i = j
    return mix64(out)


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, inv): ``mix64((s[j] - s[i]) * inv[i])`` hashes the bytes i to j, wherever they stand."""
    n = len(buf)
    _tables(n + 1)
    s = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[buf] * _POW[:n], out=s[1:])
    return s, _INVPOW


def shingle_hashes(w: Words, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``size``-word window; a row with fewer words gives its whole sequence."""
    count = np.diff(w.first)
    m = len(w.hash)
    full = max(m - size + 1, 0)
    h = np.zeros(full, U64)
    for k in range(size):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + w.hash[k:k + full] + U64(k + 1))
    same = w.row[:full] == w.row[size - 1:size - 1 + full] if full else np.empty(0, bool)
    rows, hashes = w.row[:full][same], h[same]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        sh = np.zeros(len(short), U64)
        for k in range(size):
            has = count[short] > k
            idx = w.first[short][has] + k
            sh[has] = mix64(sh[has] * U64(0x9E3779B97F4A7C15) + w.hash[idx] + U64(k + 1))
        sh = mix64(sh + U64(0xABCD) + count[short].astype(U64))
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, sh])
    return rows, hashes


def by_value(*modules) -> None:
    """Ship these modules with the functions that use them, so executors need no copy of the package."""
    from pyspark import cloudpickle
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
