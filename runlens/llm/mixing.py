"""op7: mix sources to target weights by subset-sum budget fitting.

1. Sizes (word counts) are summed per source. Sources in code point order, null last, weigh 5, 2, 1,
   repeating; together they get the total size. No target may exceed ``MAX_EPOCHS`` times its source:
   ``target = min(3 * size, rate * weight)`` with the one ``rate`` that spends the total, found over the
   sources sorted by ``3 * size / weight`` (the fixed point of resharing the excess).
2. A source is taken ``floor(target / size)`` whole times. The rest of its budget is fitted on the counts of
   documents by exact size: a proportional share of every size first, then single documents from the longest
   down until what is left is no more than ``TABLE`` or the longest size, then a bounded-knapsack reachability
   table for that remainder. The table has a cell per word of it and one step per item, so memory is bounded by
   the longest document, not by the corpus.
3. Within a (source, size) the documents with the smallest seeded hash are taken. The hash of the last one is
   the stratum's cutoff, found from counts per hash bucket and a rank inside the one bucket it falls into, so
   no stratum is ranked in one task; rows equal in id and text are told apart by their place in the input. The documents meet only a table of cutoffs.

Defined results: a null or empty text has size 0 and takes 0 words (it stays in the result); null is a source
of its own; a source without words has target 0; of rows equal in id and text as many are taken as the cutoff leaves;
an empty table gives an empty result. Input columns pass through ``mix`` unchanged, its own start with ``mix_``.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runlens.llm import common
from runlens.llm.common import WORD, by_value, scratch, stored

WEIGHTS = [5, 2, 1]
MAX_EPOCHS = 3
TABLE = 1 << 16         # cells the knapsack table may have, if no document is longer
KEY = ["mix_null", "mix_source"]


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({
        "mix_null": F.col("source").isNull(),
        "mix_source": F.coalesce(F.col("source"), F.lit("")),
        "mix_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "mix_hash": F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")),
        "mix_row": F.monotonically_increasing_id(),
    })


def source_targets(sized: DataFrame, weights: list[int] = WEIGHTS) -> DataFrame:
    """One row per source: ``mix_source_size`` and ``mix_target``. The windows see one row per source only."""
    per = sized.groupBy(*KEY).agg(F.sum("mix_size").alias("mix_source_size"))
    rank = F.row_number().over(W.orderBy(*KEY)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    cap = (F.col("mix_source_size") * MAX_EPOCHS).cast("double")
    per = per.withColumn("mix_weight", w).withColumn("mix_cap", cap)
    everything = W.partitionBy()
    before = W.orderBy(F.col("mix_cap") / F.col("mix_weight"), *KEY).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = F.sum("mix_source_size").over(everything) - F.coalesce(F.sum("mix_cap").over(before), zero)
    open_weight = F.sum("mix_weight").over(everything) - F.coalesce(F.sum("mix_weight").over(before), zero)
    rate = left / open_weight
    per = per.withColumn("mix_rate", rate)
    # the rate over "the first k are at their cap" rises until k is right and falls after it
    per = per.withColumn("mix_level", F.max("mix_rate").over(everything))
    target = F.least(F.col("mix_cap"), F.col("mix_level") * F.col("mix_weight"))
    return per.select(*KEY, "mix_source_size", target.alias("mix_target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take (at most ``counts``) so that the sum is near ``budget``, never above."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if sizes[i] > 0:
            take[i] = int(counts[i]) * budget // total
    left = budget - int((take * sizes).sum())
    most = max(int(sizes.max()), TABLE)
    while left > most:      # one more document per size, longest first; each pass lowers what is left
        for i in order:
            if take[i] < counts[i] and 0 < sizes[i] <= left and left > most:
                take[i] += 1
                left -= int(sizes[i])
    # bounded knapsack over what is left: by[s] is the item that first reached the sum s
    by = np.full(left + 1, -1, np.int64)
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        spare, part = int(counts[i] - take[i]), 1
        while spare > 0 and 0 < sizes[i] and not reached[left]:
            n = min(part, spare)
            weight = n * int(sizes[i])
            if weight > left:
                break
            new = np.flatnonzero(reached[:left + 1 - weight] & ~reached[weight:]) + weight
            by[new] = len(items)
            reached[new] = True
            items.append((int(i), n))
            spare, part = spare - n, part * 2
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("mix_size", ignore_index=True)
    size, target = int(pdf.mix_source_size[0]), float(pdf.mix_target[0])
    whole = min(int(target // size), MAX_EPOCHS) if size > 0 else 0
    budget = int(round(target - whole * size)) if whole < MAX_EPOCHS else 0
    take = fit_budget(pdf.mix_size.to_numpy(), pdf.n_docs.to_numpy(), budget)
    return pd.DataFrame({"mix_null": pdf.mix_null, "mix_source": pdf.mix_source, "mix_size": pdf.mix_size,
                         "mix_source_size": pdf.mix_source_size, "mix_target": pdf.mix_target,
                         "mix_whole": np.int64(whole), "mix_take": take})


def cutoffs(sized: DataFrame, weights: list[int] = WEIGHTS) -> DataFrame:
    """One row per (source, size): target, whole copies, and the last hash that is taken once more (null: none)."""
    stratum = [*KEY, "mix_size"]
    sized = sized.select(*stratum, "mix_hash", "mix_row").withColumn(
        "mix_bucket", F.shiftrightunsigned("mix_hash", 52).cast("int"))
    counts = sized.groupBy(*stratum, "mix_bucket").agg(F.count("*").alias("n"))
    by_size = counts.groupBy(*stratum).agg(F.sum("n").alias("n_docs"))
    fits = (by_size.join(source_targets(sized, weights), KEY).groupBy(*KEY)
            .applyInPandas(_fit_source, "mix_null boolean, mix_source string, mix_size long, mix_source_size long,"
                                        "mix_target double, mix_whole long, mix_take long"))
    upto = F.sum("n").over(W.partitionBy(*stratum).orderBy("mix_bucket"))
    edge = (counts.withColumn("upto", upto).join(fits.select(*stratum, "mix_take").where("mix_take > 0"), stratum)
            .where("upto >= mix_take and upto - n < mix_take")
            .select(*stratum, "mix_bucket", (F.col("mix_take") - F.col("upto") + F.col("n")).alias("want")))
    in_bucket = W.partitionBy(*stratum, "mix_bucket").orderBy("mix_low", "mix_row")
    last = (sized.withColumn("mix_low", F.col("mix_hash").bitwiseAND(F.lit((1 << 52) - 1)))
            .join(edge, [*stratum, "mix_bucket"]).withColumn("rank", F.row_number().over(in_bucket))
            .where("rank = want").select(*stratum, F.col("mix_bucket").alias("cut_bucket"), F.col("mix_low").alias("cut_low"), F.col("mix_row").alias("cut_row")))
    return fits.join(last, stratum, "left").drop("mix_take")


def copies(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """``sized`` with target columns and ``mix_copies``, how often each document is taken."""
    bucket = F.shiftrightunsigned("mix_hash", 52).cast("int")
    low = F.col("mix_hash").bitwiseAND(F.lit((1 << 52) - 1))
    once_more = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & (
        (low < F.col("cut_low")) | ((low == F.col("cut_low")) & (F.col("mix_row") <= F.col("cut_row")))))
    return (sized.join(cuts, [*KEY, "mix_size"])
            .withColumn("mix_copies", F.when(F.col("mix_size") == 0, 0).otherwise(
                F.col("mix_whole") + F.coalesce(once_more, F.lit(False)).cast("long")))
            .drop("cut_bucket", "cut_low", "cut_row", "mix_whole"))


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mixed corpus: every document as often as it is taken (documents without words go)."""
    with scratch() as keep:
        narrow = stored(with_size(docs, seed).select(*KEY, "mix_size", "mix_hash", "mix_row"), "mix_sizes")
        cuts = keep(stored(cutoffs(narrow, weights), "mix_cuts"))
    taken = copies(with_size(docs, seed), cuts)
    each = F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))
    return taken.withColumn("mix_n", each).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """op7's contract columns."""
    sized = stored(with_size(docs.select("doc_id", "source", "text"), seed)
                   .select("doc_id", *KEY, "mix_size", "mix_hash", "mix_row"), "mix_sizes")
    out = copies(sized, cutoffs(sized))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


by_value(common, sys.modules[__name__])
