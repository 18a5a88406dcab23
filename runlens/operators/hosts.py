"""Host-list operators (B1-B6), one allocation = one group.

All of them are projections, explodes and hash aggregates with a map-side
partial step, so a hot allocation is spread over tasks by ``(alloc, host)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.columns import (
    HOSTLIST_ITEM_RE, HOSTLIST_VALID_RE, RANGE_RE, int_or_null, nonblank, strip_ws,
)
from runlens.functions.ordering import with_group_position


# Largest number of range values one row materialises as an array.
RANGE_CHUNK = 4096
# Least number of partitions the hosts of B3 are dealt over before they are made distinct.
HOST_PARTITIONS = 200
BRACKETS_RE = r"\[([^\]]*)\]"


def distinct_hosts(df: DataFrame, alloc: str = "alloc_id", line: str = "line",
                   out: str = "host") -> DataFrame:
    """PBS node file lines -> distinct hosts per allocation (B1).

    Lines are stripped and blank lines dropped (the original kept the newline,
    so ``h`` and ``h\\n`` counted twice; see SURVEY 2.11 no. 1).
    """
    hosts = df.select(F.col(alloc), nonblank(F.col(line)).alias(out))
    return hosts.where(F.col(out).isNotNull()).dropDuplicates([alloc, out])


def expand_slots(df: DataFrame, alloc: str = "alloc_id", line: str = "line",
                 distinct: bool = False) -> DataFrame:
    """SGE host-file lines ``host slots ...`` -> one row per slot (B2).

    A line whose second field is missing or not an integer is skipped, a
    host with ``slots <= 0`` vanishes. ``distinct=True`` gives the host set
    of the original (slot counts lost); otherwise ``(alloc, host, slot)``.
    Skipping is done by exploding an empty sequence, not by a filter, so the
    line is split once per row; slots are exploded in chunks of at most
    ``RANGE_CHUNK``, so a line that asks for 2,000,000,000 slots needs no long array.
    """
    fields = df.select(F.col(alloc), F.split(strip_ws(F.col(line)), r"\s+").alias("_rl_f"))
    f = F.col("_rl_f")
    parsed = fields.select(F.col(alloc), F.get(f, 0).alias("host"),
                           F.when(F.size(f) >= 2, int_or_null(F.get(f, 1))).alias("_rl_slots"))
    ok = (F.col("_rl_slots") > 0) & (F.col("host") != "")
    if distinct:
        return parsed.select(F.col(alloc), F.explode(F.when(ok, F.array("host"))).alias("host")) \
            .dropDuplicates([alloc, "host"])
    chunks = parsed.select(F.col(alloc), "host", "_rl_slots", F.explode(F.when(ok, F.sequence(
        F.lit(1), F.col("_rl_slots"), F.lit(RANGE_CHUNK)))).alias("_rl_c"))
    c, rest = F.col("_rl_c"), F.col("_rl_slots") - F.col("_rl_c")
    return chunks.select(F.col(alloc), "host",
                         F.explode(F.sequence(c, c + F.least(rest, F.lit(RANGE_CHUNK - 1)))).alias("slot"))


def _ranges(body: Column) -> Column:
    """``08-11,15`` as an array of (low bound, width, count); malformed and reversed ranges are left out."""
    def one(r: Column) -> Column:
        low, high = F.regexp_extract(r, RANGE_RE, 1), F.regexp_extract(r, RANGE_RE, 2)
        lo = low.try_cast("long")
        hi = F.coalesce(F.nullif(high, F.lit("")), low).try_cast("long")
        return F.struct(lo.alias("lo"), F.length(low).alias("w"), (hi - lo + 1).alias("n"))
    return F.filter(F.transform(F.split(body, ","), one), lambda r: r["n"] > 0)


def _digit_text(ranges: Column, digit: Column) -> Column:
    """The number at position ``digit`` of a group's ranges, zero-padded."""
    start = F.struct(digit.alias("d"), F.lit(None).cast("string").alias("v"))

    def step(acc: Column, r: Column) -> Column:
        n = (r["lo"] + acc["d"]).cast("string")
        hit = acc["v"].isNull() & (acc["d"] < r["n"])
        return F.struct(F.when(acc["v"].isNull() & ~hit, acc["d"] - r["n"]).otherwise(acc["d"]).alias("d"),
                        F.when(hit, F.lpad(n, F.greatest(r["w"], F.length(n)), "0")).otherwise(acc["v"]).alias("v"))
    return F.aggregate(ranges, start, step, lambda acc: acc["v"])


def _combination(texts: Column, groups: Column, sizes: Column, number: Column) -> Column:
    """Text of combination ``number`` of the groups: its mixed-radix digits (the last group turns fastest) between the texts."""
    start = F.struct(number.alias("rest"), F.lit("").alias("text"))

    def step(acc: Column, k: Column) -> Column:
        size = F.get(sizes, k)
        digit = acc["rest"] % size
        return F.struct(((acc["rest"] - digit) / size).cast("long").alias("rest"),
                        F.concat(F.get(texts, k), _digit_text(F.get(groups, k), digit), acc["text"]).alias("text"))
    order = F.sequence(F.size(groups) - 1, F.lit(0), F.lit(-1))
    return F.aggregate(order, start, step, lambda acc: acc["text"])


def expand_hostlist(df: DataFrame, alloc: str = "alloc_id", expr: str = "expr",
                    out: str = "host") -> DataFrame:
    """SLURM compressed host expression -> distinct hosts per allocation.

    ``c401-[101-103,105],gpu2`` -> c401-101, c401-102, c401-103, c401-105,
    gpu2; the zero padding of a range's low bound is kept (``[08-11]``).
    Items may have any number of bracket groups (``rack[1-2]-n[01-03]``, their
    product), all by one path: the combinations of all groups but the last are
    numbered in mixed radix (a group's size comes from its ranges' bounds, so no
    value is listed), the numbers are exploded and decoded, and the last group's
    ranges are exploded by plain string expressions. Numbers are exploded in
    chunks of at most ``RANGE_CHUNK``, so no array is longer than that or the
    item's own list of ranges. A reversed or malformed range gives no host, an
    item with a bracket that is not closed or not opened gives none at all.

    A short expression stands for many hosts that are nearly all distinct, so a task that expands must not keep them in a
    table: the hosts are dealt by ``(alloc, host)`` first, over a fixed number of partitions (sized by bytes they would be
    too few), and made distinct there.
    """
    items = df.select(F.col(alloc), F.explode(
        F.regexp_extract_all(F.col(expr), F.lit(HOSTLIST_ITEM_RE), 0)).alias("_rl_item"))
    item = F.when(F.col("_rl_item").rlike(HOSTLIST_VALID_RE), F.trim("_rl_item")).otherwise(F.lit(""))
    parts = items.select(F.col(alloc), item.alias("_rl_item")).select(
        F.col(alloc), (F.col("_rl_item") != "").alias("_rl_any"),
        F.split("_rl_item", r"\[[^\]]*\]").alias("_rl_texts"),
        F.regexp_extract_all("_rl_item", F.lit(BRACKETS_RE), 1).alias("_rl_bodies"))
    n = F.size("_rl_bodies")
    groups = F.transform(F.slice("_rl_bodies", 1, F.greatest(n - 1, F.lit(0))), _ranges)
    last = F.when(n > 0, F.split(F.get("_rl_bodies", n - 1), ",")).otherwise(F.array(F.lit(None).cast("string")))
    parts = parts.select(F.col(alloc), "_rl_any", "_rl_texts", F.when(n > 1, groups).alias("_rl_groups"),
                         last.alias("_rl_last"), F.get("_rl_texts", n).alias("_rl_suf"))
    sizes = F.transform("_rl_groups", lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, r: a + r["n"]))
    parts = parts.withColumn("_rl_sizes", sizes)
    several = F.col("_rl_groups").isNotNull()
    total = F.aggregate("_rl_sizes", F.lit(1).cast("long"), lambda a, s: a * s)
    parts = parts.withColumn("_rl_total", total)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    chunk = F.lit(RANGE_CHUNK).cast("long")
    combos = parts.select("*", F.explode(
        F.when(~F.col("_rl_any"), none).when(~several, F.array(zero))
        .when(F.col("_rl_total") > 0, F.sequence(zero, F.col("_rl_total") - 1, chunk)).otherwise(none)).alias("_rl_first"))
    combos = combos.select("*", F.explode(F.when(several, F.sequence(
        F.col("_rl_first"), F.least(F.col("_rl_first") + chunk - 1, F.col("_rl_total") - 1))).otherwise(F.array(zero))).alias("_rl_number"))
    head = F.when(several, F.concat(
        _combination(F.col("_rl_texts"), F.col("_rl_groups"), F.col("_rl_sizes"), F.col("_rl_number")),
        F.get("_rl_texts", F.size("_rl_groups")))).otherwise(F.get("_rl_texts", F.lit(0)))
    ranges = combos.select(F.col(alloc), head.alias("_rl_pre"), "_rl_suf", "_rl_last") \
        .select(F.col(alloc), "_rl_pre", "_rl_suf", F.explode("_rl_last").alias("_rl_r"))
    low, high = F.regexp_extract("_rl_r", RANGE_RE, 1), F.regexp_extract("_rl_r", RANGE_RE, 2)
    bounds = ranges.select(
        F.col(alloc), "_rl_pre", "_rl_suf", "_rl_r", F.length(low).alias("_rl_w"), low.try_cast("long").alias("_rl_lo"),
        F.coalesce(F.nullif(high, F.lit("")), low).try_cast("long").alias("_rl_hi"))
    lo, hi = F.col("_rl_lo"), F.col("_rl_hi")
    plain = F.col("_rl_r").isNull()       # an item without brackets
    chunks = bounds.select(
        F.col(alloc), "_rl_pre", "_rl_suf", "_rl_w", "_rl_hi",
        F.explode(F.when(plain, F.array(F.lit(None).cast("long")))
                  .when(lo.isNotNull() & (hi >= lo), F.sequence(lo, hi, chunk)).otherwise(none)).alias("_rl_c"))
    c = F.col("_rl_c")
    numbers = chunks.select(
        F.col(alloc), "_rl_pre", "_rl_suf", "_rl_w",
        F.explode(F.when(c.isNull(), F.array(F.lit(None).cast("long")))
                  .otherwise(F.sequence(c, F.least(c + F.lit(RANGE_CHUNK - 1), F.col("_rl_hi"))))).alias("_rl_num"))
    num = F.col("_rl_num").cast("string")
    host = F.when(num.isNull(), F.col("_rl_pre")).otherwise(F.concat(
        F.col("_rl_pre"), F.lpad(num, F.greatest(F.col("_rl_w"), F.length(num)), "0"), F.col("_rl_suf")))
    parts = max(HOST_PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return numbers.select(F.col(alloc), host.alias(out)).repartition(parts, alloc, out).dropDuplicates([alloc, out])


def first_present(df: DataFrame, cols: Sequence[str], default: str | None = "localhost",
                  out: str = "value", source_out: str | None = "source",
                  skip_empty: bool | Sequence[str] = True) -> DataFrame:
    """First source that is set wins, else ``default``.

    ``skip_empty`` says which columns count an empty string as unset
    (``True``: all). ``source_out`` names the winning column or ``default``.
    """
    if skip_empty is True:
        blank_unset = set(cols)
    elif not skip_empty:
        blank_unset = set()
    else:
        blank_unset = set(skip_empty)

    def present(c: str) -> Column:
        col = F.col(c)
        return F.nullif(col, F.lit("")) if c in blank_unset else col

    value = F.coalesce(*[present(c) for c in cols], F.lit(default))
    out_df = df.withColumn(out, value)
    if source_out:
        src = None
        for c in cols:
            cond = present(c).isNotNull()
            src = F.when(cond, F.lit(c)) if src is None else src.when(cond, F.lit(c))
        out_df = out_df.withColumn(source_out, src.otherwise(F.lit("default")))
    return out_df


def apply_defaults(df: DataFrame, spec: dict[str, tuple[object, str]]) -> DataFrame:
    """Per-field defaults with casts: ``{col: (default, type)}``.

    Text that does not cast (``'x'`` for an int) counts as unset.
    """
    out = df
    for col, (default, dtype) in spec.items():
        raw = F.nullif(F.trim(F.col(col).cast("string")), F.lit(""))
        typed = int_or_null(raw, dtype) if dtype in ("int", "bigint", "smallint") \
            else raw.try_cast(dtype)
        out = out.withColumn(col, F.coalesce(typed, F.lit(default).cast(dtype)))
    return out


def assign_ids(df: DataFrame, alloc: str = "alloc_id", host: str = "host",
               id_col: str = "node_id", master_col: str | None = "is_master",
               skew_safe: bool = True) -> DataFrame:
    """Dense ids 0..n-1 per allocation in ascending host order.

    The first host is the master. Duplicate hosts get one id. The position is
    computed by ``with_group_position``, so a huge allocation is numbered by
    many tasks, not one.
    """
    hosts = df.select(alloc, host).where(F.col(host).isNotNull()).dropDuplicates([alloc, host])
    out = with_group_position(hosts, [alloc], [host], pos_col=id_col, skew_safe=skew_safe)
    if master_col:
        out = out.withColumn(master_col, F.col(id_col) == 0)
    return out


def node_count(df: DataFrame, alloc: str = "alloc_id", host: str = "host",
               out: str = "n_nodes") -> DataFrame:
    """Distinct hosts per allocation (B6); planned as a two-step aggregate."""
    return df.groupBy(alloc).agg(F.countDistinct(host).alias(out))
