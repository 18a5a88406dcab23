"""Newest entries and phase timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.ordering import with_group_position


def _order(ts: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(ts).desc()] + [F.col(t).asc() for t in tiebreak]


def latest_by_prefix(df: DataFrame, key: str | None, name: str, ts: str,
                     prefix: str) -> DataFrame:
    """Per key, the name starting with ``prefix`` with the greatest time.

    Ties go to the smallest name; a key without such names gives no row.
    ``row_number() = 1`` is planned as a partial ``WindowGroupLimit`` before
    the shuffle, so each task ships at most one row per key.
    """
    cand = df.where(F.col(name).startswith(prefix))
    order = _order(ts, [name])
    if key is None:
        return cand.orderBy(*order).limit(1)
    w = Window.partitionBy(key).orderBy(*order)
    return cand.withColumn("_rl_rn", F.row_number().over(w)) \
        .where(F.col("_rl_rn") == 1).drop("_rl_rn")


def newest(df: DataFrame, key: str | None, ts: str, limit: int | None = None,
           tiebreak: Sequence[str] = (), rank: str = "rank",
           skew_safe: bool = True) -> DataFrame:
    """Entries by time, newest first (D2), with a 1-based ``rank`` (int for
    top-k, which is bounded by k; bigint for every row ranked).

    * ``key=None, limit=k``: global top-k (``TakeOrderedAndProject``).
    * ``key, limit=k``: top-k per key (partial ``WindowGroupLimit``).
    * ``limit=None``: every row ranked; uses ``with_group_position`` so a hot
      key is ranked by many tasks.
    """
    order = _order(ts, tiebreak)
    if key is None and limit is not None:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    if limit is not None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)
    keys = [key] if key else []
    if not keys:
        df = df.withColumn("_rl_all", F.lit(0))
        keys = ["_rl_all"]
    out = with_group_position(df, keys, order, pos_col=rank, skew_safe=skew_safe) \
        .withColumn(rank, F.col(rank) + 1)
    return out.drop("_rl_all") if key is None else out


def phase_durations(df: DataFrame, run: str, ts: str, tiebreak: Sequence[str] = (),
                    seq: str = "seq", step: str = "step_us", total: str = "total_us",
                    skew_safe: bool = True) -> DataFrame:
    """Consecutive clock differences per run (D3), in integer microseconds.

    ``step`` = this reading minus the previous one (NULL for the first),
    ``total`` = this reading minus the run's first. ``seq`` is the 0-based
    position. The run start comes from the same per-slice summary as the
    predecessor, so no extra pass over the rows is needed.
    """
    order = [F.col(ts).asc()] + [F.col(t).asc() for t in tiebreak]
    pos = with_group_position(df, [run], order, prev=[ts], first=[ts], pos_col=seq,
                              prev_prefix="_rl_prev_", first_prefix="_rl_first_",
                              skew_safe=skew_safe)
    out = pos.withColumn(step, F.timestamp_diff("MICROSECOND", F.col(f"_rl_prev_{ts}"), F.col(ts))) \
        .withColumn(total, F.timestamp_diff("MICROSECOND", F.col(f"_rl_first_{ts}"), F.col(ts)))
    return out.drop(f"_rl_prev_{ts}", f"_rl_first_{ts}")
