"""Rows of a stream packed by key before they reach a stateful operator.

Spark hands a stateful pandas operator its input row by row as Python objects, so a busy key costs one task some 40 microseconds a row
before the operator has done anything. ``packed`` puts the rows of one key that a task holds at a time into one row, whose columns
travel as bytes. It keeps no state and reorders nothing that matters to operators which sort by time.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 18          # rows of a task looked at together
PACK = 4096             # rows of one pack, at most


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of (key, the latest micros, the columns after the key in one row of bytes); the first two columns are key and micros."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield _packs(held)
            held, n = [], 0
    if n:
        yield _packs(held)


def _packs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = table.column(0).combine_chunks().dictionary_encode("encode")
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    code = keys.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code = code[order]
    cols = [c.to_numpy()[order] for c in table.columns[1:]]
    begin = np.flatnonzero(np.diff(code, prepend=-1) != 0)
    size = np.diff(begin, append=len(code))
    cuts = np.concatenate([np.arange(b, b + s, PACK) for b, s in zip(begin[size > PACK], size[size > PACK])] + [begin[size <= PACK]])
    cuts = np.sort(cuts)
    ends = np.append(cuts[1:], len(code))
    blobs = [pickle.dumps([c[a:b].tolist() for c in cols], pickle.HIGHEST_PROTOCOL) for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[cuts])), pa.array(np.maximum.reduceat(cols[0], cuts)),
                                       pa.array(blobs, pa.binary())], names=["key", "us", "pack"])


def packed(rows: DataFrame) -> DataFrame:
    """``(key, us, pack)`` for the rows of a stream: text key, micros (not NULL) and other columns. ``us`` is the latest of the pack, so a
    watermark on it stands where it would on the rows; the rows of a pack are ``unpacked(pack)``. The rows are dealt out by key
    first, or packs would be small wherever the input mixes its keys."""
    return rows.repartition(rows.columns[0]).mapInArrow(pack, "key string, us long, pack binary")


def unpacked(pack: bytes) -> list[list]:
    """The columns after the key."""
    return pickle.loads(pack)
