"""Position and predecessor of each row inside its group, safe for hot groups.

``row_number()`` / ``lag()`` over ``Window.partitionBy(key)`` put a whole
group into one task. When one run or allocation holds a third of all rows
that single task is the job. ``with_group_position`` computes the same
values with the group split across many tasks:

1. ``repartitionByRange(n, *keys, *order)`` cuts the global order into ``n``
   contiguous slices; a hot group spans many slices.
2. A window over ``(keys, slice)`` numbers rows and takes ``lag`` *inside*
   each slice; every window group is at most one slice.
3. One summary row per ``(key, slice)`` (count and last values) is small:
   at most ``#keys + n`` rows. A window over it by key (at most ``n`` rows
   per key) gives each slice its offset and the last values of the slice
   before it.
4. Only keys that cross a slice boundary need a fix (offset, predecessor of
   a slice's first row, first values). There are at most ``2 (n - 1)`` such
   (key, slice) rows, whatever the data. If their columns have a fixed width,
   the table's bytes are known and, within a limit, it is broadcast, so the
   rows move in two shuffles (range, then (key, slice) for the window);
   otherwise the join is left to AQE, which measures the side first.

The range partitioner samples with a seed that depends on the RDD, so two
independent evaluations of the range exchange may cut different slices.
The sliced frame is therefore persisted: the rows and the summary are read
from the same slices, also when a lost block is recomputed (it is rebuilt
from the same shuffle and partitioner). The partition count is explicit, so
AQE does not coalesce the range exchange. The order must be total (add a
unique tie-breaker) for repeatable results. The persisted slices are
released with ``spark.catalog.clearCache()`` (or when the session ends).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

_SEG = "_rl_seg"
_RN = "_rl_rn"
_CNT = "_rl_cnt"
_OFF = "_rl_off"
_NSEG = "_rl_nseg"
_SIZE = "_rl_gsize"


def _sort_key(o: Column | str) -> Column:
    return F.col(o) if isinstance(o, str) else o


# The boundary-fix table of the split plan has at most 2 (n - 1) rows. A row
# holds numbers, keys and carried values of bounded width only if all its
# columns have a fixed-width type; only then is its size known before running
# and the table broadcast, up to this many bytes.
MAX_FIX_BYTES_CONF = "spark.runlens.maxBroadcastFixBytes"
MAX_FIX_BYTES = 64 << 20
FIXED_BYTES = 16        # of one fixed-width value, at most (decimal, timestamp, long)


def _fix_bytes(df: DataFrame, columns: Sequence[str], n: int) -> int | None:
    """Bound on the fix table's bytes, None if a column has no fixed width."""
    for c in columns:
        if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return None
    return 2 * max(n - 1, 0) * FIXED_BYTES * (len(columns) + 4)

def with_group_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                        prev: Sequence[str] = (), pos_col: str = "pos",
                        prev_prefix: str = "prev_", num_partitions: int | None = None,
                        skew_safe: bool = True, first: Sequence[str] = (),
                        first_prefix: str = "first_", size_col: str | None = None,
                        weight: str | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position within the key group under ``order``),
    (bigint on both plans), ``prev_<c>`` (value of ``c`` on the preceding row,
    NULL for the first) and
    ``first_<c>`` (value of ``c`` on the group's first row). ``size_col``
    adds the group's row count (bigint), so a caller can pick rows by
    position (``pos = size - 1``, a percentile's position) with a filter
    instead of a join.

    ``weight`` names a bigint column: a row then counts that often, its
    position is the weight of the rows before it and the size their sum.

    ``skew_safe=True`` (default) splits groups into slices at every size, so
    the plan never depends on the data; ``False`` is the plain one-window
    plan (one shuffle, whole group per task) for callers who know that their
    groups fit a task. Both give the same rows and types.
    """
    if df.isStreaming:
        raise ValueError("with_group_position needs a batch DataFrame; for streams use "
                         "runlens.streaming (stateful aggregates and processors)")
    keys = list(keys)
    order_cols = [_sort_key(o) for o in order]
    own = F.col(weight) if weight else F.lit(1).cast("long")

    def before(w) -> Column:
        """Weight of the rows before this one in its window."""
        if not weight:
            return (F.row_number().over(w) - F.lit(1)).cast("long")
        return F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - own

    if not skew_safe:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        out = df.withColumn(pos_col, before(w))
        for c in prev:
            out = out.withColumn(f"{prev_prefix}{c}", F.lag(c).over(w))
        for c in first:
            out = out.withColumn(f"{first_prefix}{c}", F.first(c).over(w))
        if size_col:
            out = out.withColumn(size_col, F.sum(own).over(Window.partitionBy(*keys)))
        return out

    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols) \
        .withColumn(_SEG, F.spark_partition_id())

    w_slice = Window.partitionBy(*keys, _SEG).orderBy(*order_cols)
    w_slice_all = Window.partitionBy(*keys, _SEG)
    local = ranged.withColumn(_RN, before(w_slice)) \
        .withColumn(_CNT, F.sum(own).over(w_slice_all))
    for c in prev:
        local = local.withColumn(f"_rl_lp_{c}", F.lag(c).over(w_slice))
    for c in first:
        local = local.withColumn(f"_rl_lf_{c}", F.first(c).over(w_slice))
    local = local.persist(StorageLevel.MEMORY_AND_DISK)

    # One row per (key, slice): its size, the values of its last row and of
    # its first row.
    summary = local.filter(F.col(_RN) + own == F.col(_CNT)) \
        .select(*keys, _SEG, _CNT, *[F.col(c).alias(f"_rl_last_{c}") for c in prev],
                *[F.col(f"_rl_lf_{c}").alias(f"_rl_sf_{c}") for c in first])
    w_key = Window.partitionBy(*keys).orderBy(_SEG)
    w_key_all = Window.partitionBy(*keys)
    summary = summary.withColumn(_OFF, F.sum(_CNT).over(w_key) - F.col(_CNT)) \
        .withColumn(_NSEG, F.count(F.lit(1)).over(w_key_all)) \
        .withColumn(_SIZE, F.sum(_CNT).over(w_key_all))
    for c in prev:
        summary = summary.withColumn(f"_rl_pl_{c}", F.lag(f"_rl_last_{c}").over(w_key))
    for c in first:
        summary = summary.withColumn(f"_rl_gf_{c}", F.first(f"_rl_sf_{c}").over(w_key))
    # Only a key that crosses a slice boundary needs a correction; a key inside
    # one slice already has offset 0, no predecessor before its first row and
    # its own first values. Each of the n - 1 boundaries is crossed by at most
    # one key, so at most 2 (n - 1) rows remain: a bound set by the partition
    # count, not by the data, so this side is broadcast and the rows are not
    # shuffled again.
    fixes = summary.where(F.col(_NSEG) > 1) \
        .select(*[F.col(k).alias(f"_rl_k_{k}") for k in keys],
                F.col(_SEG).alias("_rl_sseg"), _OFF, _SIZE,
                *[f"_rl_pl_{c}" for c in prev], *[f"_rl_gf_{c}" for c in first])

    # Null-safe on the keys: a NULL run key is a group like any other. The
    # fixes' columns are renamed, so the self-join is unambiguous; rows of
    # keys inside one slice find no fix (left join).
    cond = [F.col(k).eqNullSafe(F.col(f"_rl_k_{k}")) for k in keys] \
        + [F.col(_SEG) == F.col("_rl_sseg")]
    # The bound is known before running anything: broadcast while it fits,
    # else leave the join to AQE (a shuffle join of the rows on (key, slice)).
    size = _fix_bytes(df, [*keys, *prev, *first], n)
    most = int(spark.conf.get(MAX_FIX_BYTES_CONF, str(MAX_FIX_BYTES)))
    right = F.broadcast(fixes) if size is not None and size <= most else fixes
    out = local.join(right, on=cond, how="left")
    fixed = F.col("_rl_sseg").isNotNull()
    out = out.withColumn(pos_col, F.coalesce(F.col(_OFF), F.lit(0)) + F.col(_RN))
    for c in prev:
        out = out.withColumn(f"{prev_prefix}{c}",
                             F.when(F.col(_RN) == 0, F.col(f"_rl_pl_{c}"))
                             .otherwise(F.col(f"_rl_lp_{c}")))
    for c in first:
        out = out.withColumn(f"{first_prefix}{c}",
                             F.when(fixed, F.col(f"_rl_gf_{c}")).otherwise(F.col(f"_rl_lf_{c}")))
    if size_col:
        # A key inside one slice: the slice's count is the group's size.
        out = out.withColumn(size_col, F.when(fixed, F.col(_SIZE)).otherwise(F.col(_CNT)))
    out = out.drop("_rl_sseg", *[f"_rl_k_{k}" for k in keys])
    helper = [_SEG, _RN, _CNT, _OFF, _SIZE] + [f"_rl_{k}_{c}" for c in prev for k in ("lp", "pl")] \
        + [f"_rl_{k}_{c}" for c in first for k in ("lf", "gf")]
    return out.drop(*helper)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys (``<=>``).

    The right side's key columns are renamed first, so self-joins of frames
    derived from one another stay unambiguous; the result keeps the left keys.
    """
    keys = list(keys)
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_rl_rk_{k}")
    cond = [F.col(k).eqNullSafe(F.col(f"_rl_rk_{k}")) for k in keys]
    return left.join(r, on=cond, how=how).drop(*[f"_rl_rk_{k}" for k in keys])
