"""Statistics over trace values (D4) and scaling against the smallest size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.ordering import join_on_keys, with_group_position


def _pct_name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def run_stats(df: DataFrame, keys: Sequence[str], value: str, scale: int = 5,
              percentiles: Sequence[float] = (0.5, 0.9), approx: bool = False,
              skew_safe: bool = True) -> DataFrame:
    """Per group: ``n, mean, stddev, min, max`` and percentiles.

    * ``mean`` is exact: a decimal sum in units of ``10^-scale``, divided and
      rounded once, half away from zero, as ``decimal(18, scale)``.
    * ``stddev`` (sample) is a double; count, sum, min and max are algebraic
      aggregates with a map-side partial step.
    * Percentiles are exact and interpolated (``(n-1)q``, as ``percentile``
      / ``quantile_cont``), by one plan at every size: equal values of a group
      are counted first (with a partial step, so a value that repeats without
      end costs a row per task), ``with_group_position`` sums the counts over
      the distinct values in slices that can be cut anywhere, and a filter
      keeps the at most two values each percentile lies on. ``approx=True`` uses
      ``percentile_approx`` instead (one pass, bounded memory, approximate).
    """
    keys = list(keys)
    v = F.col(value)
    units = F.round(v.cast("decimal(38,10)") * F.lit(10 ** scale)).cast("decimal(38,0)")
    aggs = [F.count(v).alias("n"), F.sum(units).cast("decimal(38,0)").alias("_rl_su"),
            F.stddev_samp(v.cast("double")).alias("stddev"),
            F.min(v).alias("min"), F.max(v).alias("max")]
    if approx and percentiles:
        aggs.append(F.percentile_approx(v.cast("double"), list(percentiles), 10000).alias("_rl_pa"))
    stats = df.groupBy(*keys).agg(*aggs)
    unit = "0." + "0" * (scale - 1) + "1" if scale > 0 else "1"
    whole = F.expr("(abs(_rl_su) * 2 + n) div (2 * n)")       # |sum| / n, rounded half up
    mean = (F.signum("_rl_su").cast("decimal(1,0)") * whole.cast("decimal(20,0)") * F.expr(unit)).cast(f"decimal(18,{scale})")
    stats = stats.withColumn("mean", F.when(F.col("n") > 0, mean)).drop("_rl_su")
    if not percentiles:
        return stats
    if approx:
        for i, q in enumerate(percentiles):
            stats = stats.withColumn(_pct_name(q), F.col("_rl_pa").getItem(i))
        return stats.drop("_rl_pa")

    counts = df.select(*keys, v.cast("double").alias("_rl_v")).where(F.col("_rl_v").isNotNull()) \
        .groupBy(*keys, "_rl_v").agg(F.count(F.lit(1)).alias("_rl_c"))
    pos = with_group_position(counts, keys, [F.col("_rl_v")], pos_col="_rl_pos", size_col="_rl_n",
                              weight="_rl_c", skew_safe=skew_safe)
    # A value stands at the positions _rl_pos .. _rl_pos + _rl_c - 1 of its
    # group, so the (at most two) values each percentile needs are kept by a
    # filter; a group ships at most 2 rows per percentile to the aggregate.
    start, end, n = F.col("_rl_pos"), F.col("_rl_pos") + F.col("_rl_c"), F.col("_rl_n")

    def holds(i: Column) -> Column:
        return (start <= i) & (i < end)

    ends = []
    for q in percentiles:
        idx = (n - 1) * F.lit(float(q))
        ends.append((F.floor(idx).cast("long"), F.ceil(idx).cast("long"), idx - F.floor(idx)))
    wanted = F.lit(False)
    for lo, hi, _ in ends:
        wanted = wanted | holds(lo) | holds(hi)
    picked = pos.where(wanted)
    sel = []
    for i, (lo, hi, fr) in enumerate(ends):
        sel += [F.max(F.when(holds(lo), F.col("_rl_v"))).alias(f"_rl_lv{i}"),
                F.max(F.when(holds(hi), F.col("_rl_v"))).alias(f"_rl_hv{i}"),
                F.max(fr).alias(f"_rl_f{i}")]
    pv = picked.groupBy(*keys).agg(*sel)
    for i, q in enumerate(percentiles):
        lo, hi, fr = F.col(f"_rl_lv{i}"), F.col(f"_rl_hv{i}"), F.col(f"_rl_f{i}")
        pv = pv.withColumn(_pct_name(q), lo + (hi - lo) * fr)
    pv = pv.select(*keys, *[_pct_name(q) for q in percentiles])
    return join_on_keys(stats, pv, keys, how="left")


def scaling_ratio(df: DataFrame, series: Sequence[str], size: str, value: str,
                  out: str = "speedup", base_size: str = "base_size") -> DataFrame:
    """``value`` at the smallest ``size`` of the series divided by ``value``.

    The base is a ``min_by`` aggregate per series joined back, not a window,
    so no series is ever sorted in one task.
    """
    series = list(series)
    base = df.groupBy(*series).agg(F.min_by(F.col(value), F.col(size)).alias("_rl_base"),
                                   F.min(size).alias(base_size))
    return join_on_keys(df, base, series) \
        .withColumn(out, F.col("_rl_base").cast("double") / F.col(value).cast("double")) \
        .drop("_rl_base")
