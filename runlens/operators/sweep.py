"""Benchmark sweep grid and its missing runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_grid(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Every row of ``df`` times every value of each array column in ``dims``.

    Successive ``explode``s: the product is generated inside each task, no
    join (and no cross join) is planned.
    """
    out = df
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(values))
    return out


def sweep_grid(spark: SparkSession, reps: int, dims: dict[str, Sequence], rep: str = "rep") -> DataFrame:
    """The nested-loop sweep (``reps`` x each list in ``dims``) as rows."""
    base = spark.range(reps).select(F.col("id").cast("int").alias(rep))
    return expand_grid(base, {k: F.array(*[F.lit(x) for x in v]) for k, v in dims.items()})


def missing_runs(grid: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells with no matching row in ``present`` (D7): a left anti join.

    ``present`` is reduced to its distinct keys first: the map-side partial
    aggregate shrinks the shuffle to one row per key and task, and its hash
    partitioning on the keys is the one the join needs. A NULL key is a value
    like any other.
    """
    keys = list(keys)
    seen = present.select(*[F.col(k).alias(f"_rl_p_{k}") for k in keys]).dropDuplicates()
    return grid.join(seen, on=[F.col(k).eqNullSafe(F.col(f"_rl_p_{k}")) for k in keys], how="left_anti")


WORD_BITS = 64
WORDS_AT_ONCE = 4096


def missing_cells(units: DataFrame, present: DataFrame, keys: Sequence[str], dims: dict[str, Column]) -> DataFrame:
    """Grid cells of each unit with no row in ``present`` (D6 and D7 in one), as ``missing_runs(expand_grid(...))`` finds them.

    ``dims`` holds one array per grid column, the same for every row (literals or a scalar subquery). Cells are numbered in mixed
    radix; a row of ``present`` sets one bit of the 64-bit word of its cell, the words of each (key, word) are merged by a partial
    ``bit_or``, and the zero bits of the words are the missing cells. So what is shuffled is one row per unit and 64 cells, neither a
    row per grid cell nor one per present cell, and the words of a unit lie in many tasks.

    A NULL key is a unit like any other; repeated units and repeated grid values count once; a NULL in a grid column of
    ``present`` and values outside the grid match no cell, and the grid's own values must not be NULL. An empty grid gives no row.
    """
    keys, names = list(keys), list(dims)
    values = {c: F.array_distinct(v) for c, v in dims.items()}
    size = {c: F.size(v).cast("long") for c, v in values.items()}
    total = F.lit(1).cast("long")
    for c in names:
        total = total * size[c]
    cell = F.lit(0).cast("long")
    for c in names:
        at = F.array_position(values[c], F.col(c))
        cell = cell * size[c] + F.when(at > 0, at - 1)         # NULL where the value is not in the grid
    seen = present.select(*keys, cell.alias("_rl_cell")).where(F.col("_rl_cell").isNotNull()) \
        .select(*keys, F.floor(F.col("_rl_cell") / WORD_BITS).cast("long").alias("_rl_word"),
                F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_rl_cell") % WORD_BITS).cast("int")).alias("_rl_bits"),
                F.lit(False).alias("_rl_unit"))
    last = F.floor((total - 1) / WORD_BITS).cast("long")
    words = units.select(*keys).dropDuplicates().where(total > 0) \
        .withColumn("_rl_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / WORDS_AT_ONCE).cast("long")))) \
        .withColumn("_rl_word", F.explode(F.sequence(F.col("_rl_hi") * WORDS_AT_ONCE, F.least((F.col("_rl_hi") + 1) * WORDS_AT_ONCE - 1, last)))) \
        .select(*keys, "_rl_word", F.lit(0).cast("long").alias("_rl_bits"), F.lit(True).alias("_rl_unit"))
    merged = words.unionByName(seen).groupBy(*keys, "_rl_word").agg(F.bit_or("_rl_bits").alias("_rl_bits"), F.bool_or("_rl_unit").alias("_rl_unit")) \
        .where("_rl_unit")
    zero = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.getbit("_rl_bits", b) == 0)
    out = merged.select(*keys, F.col("_rl_word"), F.explode(zero).alias("_rl_bit")) \
        .select(*keys, (F.col("_rl_word") * WORD_BITS + F.col("_rl_bit")).alias("_rl_cell")).where(F.col("_rl_cell") < total)
    rest, found = F.col("_rl_cell"), {}
    for c in reversed(names):
        found[c] = F.get(values[c], (rest % size[c]).cast("int"))
        rest = F.floor(rest / size[c]).cast("long")
    return out.select(*keys, *[found[c].alias(c) for c in names])


def within_limit(keys: Sequence[str], at: str, done: str, limit_s: float) -> list[Column]:
    """Join condition: equal keys (NULLs too, on the right as ``_rl_p_<key>``) and ``done`` from ``at`` up to ``limit_s`` later."""
    limit = F.expr(f"INTERVAL {int(round(limit_s * 1_000_000))} MICROSECOND")
    return [F.col(k).eqNullSafe(F.col(f"_rl_p_{k}")) for k in keys] \
        + [F.col(done) >= F.col(at), F.col(done) <= F.col(at) + limit]


def missing_phase(starts: DataFrame, done: DataFrame, keys: Sequence[str], ts: str, limit_s: float) -> DataFrame:
    """Starts whose phase did not come within ``limit_s`` (D7 over time): a left anti join on the keys within the limit.

    Several finished phases of a key at one time are one. Starts without a time are left out.
    """
    seen = done.select(*[F.col(k).alias(f"_rl_p_{k}") for k in keys], F.col(ts).alias("_rl_done")).dropDuplicates()
    return starts.where(F.col(ts).isNotNull()).join(seen, on=within_limit(keys, ts, "_rl_done", limit_s), how="left_anti")
