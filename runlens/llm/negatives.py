"""op13: hard negatives by angular triangle filtering.

Every row's vector is scaled to integers once, and stored with its norm and its angles to a few reference directions
(rows of a bounded sample, each the farthest from those before). Two angles to one direction bound the angle between
two rows from both sides (triangle inequality on the sphere); the cosines of the bounds times both norms, rounded
outward, bound their integer score. Only pairs whose bounds meet the wanted window get the integer inner product:

1. positives: in a block of rows an anchor's window starts at its ``positives``-th best lower bound among rows of its label;
   the best of every block are merged per anchor;
2. negatives: each positive's score gives a window of scores; rows of other labels whose bounds meet it are scored, the
   first of each window and block are kept and merged per anchor and positive.

Anchors and rows meet in a grid of blocks of bounded size, dealt by a hash of a row number, so neither a common vector nor
a common label or id gathers in one task. Scores are exact: products in double precision while they stay below 2^53, and
Python integers beyond.

Defined results: rows with a null id, label or vector, with a null or non-finite component (also once scaled), or with
another length than most rows take no part. "Other" rows are those with another id; a repeated row is a row of its own,
also as an anchor. A zero vector scores 0 with every row. Scores beyond 64 bits are the nearest end. Anchors without a
positive, and positives whose window is empty, give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import by_value, stored

REFERENCES = 16
SAMPLE = 4096        # rows that the reference directions are taken from
BLOCK = 4096         # rows, and anchors, of one block
CHUNK = 128          # anchors whose bounds are held at once
ANGLE_ERROR = 1e-6   # more than the error of arccos in double precision
EXACT = float(1 << 53)
LOW, HIGH = (3, 10), (9, 10)     # a negative's score lies between these shares of the positive's

INDEX = "uid long, vec_id long, label long, v array<double>, norm double, theta array<double>"
PAIRS = "uid long, anchor_id long, other_id long, score long"
WINDOWS = "uid long, anchor_id long, place int, positive_id long, positive_score long, other_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LONG = (-(1 << 63), (1 << 63) - 1)


def valid(rows: DataFrame) -> DataFrame:
    """``uid, vec_id, label, v`` (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256.0) != float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
            .where(F.coalesce(ok, F.lit(False))))


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, also where squares leave the range of doubles."""
    top = np.abs(x).max(axis=1) if x.size else np.zeros(len(x))
    safe = np.where(top > 0, top, 1.0)
    y = x / safe[:, None]
    return np.sqrt((y * y).sum(axis=1)) * top


def angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of every row to every reference direction; a zero row stands at a right angle to all."""
    top = np.abs(x).max(axis=1) if x.size else np.zeros(len(x))
    y = x / np.where(top > 0, top, 1.0)[:, None]
    length = np.sqrt((y * y).sum(axis=1))
    return np.arccos(np.clip(y @ refs.T / np.where(length > 0, length, 1.0)[:, None], -1, 1))


def directions(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit rows of a sample: the first, then always the one farthest from those taken."""
    x = x[np.abs(x).max(axis=1) > 0]
    if not len(x):
        return np.empty((0, x.shape[1]))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    taken, near = [0], x @ x[0]
    while len(taken) < min(count, len(x)):
        far = int(near.argmin())
        if far in taken:
            break
        taken.append(far)
        near = np.maximum(near, x @ x[far])
    return x[taken]


def bounds(a_theta: np.ndarray, a_norm: np.ndarray, theta: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of every anchor with every row, rounded outward to whole numbers."""
    shape = len(a_norm), len(norm)
    least, most = np.zeros(shape), np.full(shape, np.pi)
    for r in range(theta.shape[1]):
        p, q = a_theta[:, r][:, None], theta[:, r][None, :]
        np.maximum(least, np.abs(p - q), out=least)
        both = p + q
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    with np.errstate(over="ignore", invalid="ignore"):
        size = a_norm[:, None] * norm[None, :]
        slack = size * 1e-9 + 1
        low = np.floor(size * np.cos(np.minimum(most + ANGLE_ERROR, np.pi)) - slack)
        high = np.ceil(size * np.cos(np.maximum(least - ANGLE_ERROR, 0)) + slack)
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def inner(a: np.ndarray, a_norm: float, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Integer inner products of one anchor with some rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        safe = norm * a_norm < EXACT / 2
        out = np.where(safe, x @ a, 0).astype(np.int64)
    for i in np.flatnonzero(~safe):
        s = sum(int(p) * int(q) for p, q in zip(a.tolist(), x[i].tolist()))
        out[i] = min(max(s, _LONG[0]), _LONG[1])
    return out


def share(score, part: tuple[int, int], up: bool):
    """``score * part`` rounded up or down to a whole number, without leaving 64 bits."""
    p, q = part
    whole, rest = score // q, score % q
    return whole * p + (-((-rest * p) // q) if up else (rest * p) // q)


def windows(positive) -> tuple:
    """Least and greatest score of a negative for a positive's score (least above greatest: none)."""
    return share(positive, LOW, True), share(positive, HIGH, False)


class Side:
    """A block's columns as arrays."""

    def __init__(self, pdf: pd.DataFrame, prefix: str = ""):
        pdf = pdf.rename(columns=lambda c: c.removeprefix(prefix))
        self.uid, self.id, self.label = (pdf[c].to_numpy() for c in ("uid", "vec_id", "label"))
        self.v, self.theta = np.stack(pdf.v.to_list()).astype(float), np.stack(pdf.theta.to_list()).astype(float)
        self.norm = pdf.norm.to_numpy()


def best_positives(anchors: pd.DataFrame, rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Each anchor's ``n`` first rows of its own label in one block."""
    out = []
    if len(anchors) and len(rows):
        a, b = Side(anchors, "a_"), Side(rows)
        for k in range(0, len(a.id), CHUNK):
            low, high = bounds(a.theta[k:k + CHUNK], a.norm[k:k + CHUNK], b.theta, b.norm)
            for i in range(k, k + len(low)):
                at = np.flatnonzero((b.label == a.label[i]) & (b.id != a.id[i]))
                if len(at) > n:   # at least n rows reach the n-th best lower bound
                    least = np.partition(low[i - k, at], len(at) - n)[len(at) - n]
                    at = at[high[i - k, at] >= least]
                score = inner(a.v[i], a.norm[i], b.v[at], b.norm[at])
                first = np.lexsort((~b.id[at], score))[::-1][:n]
                out.append((np.full(len(first), a.uid[i]), np.full(len(first), a.id[i]), b.id[at][first], score[first]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("uid", "anchor_id", "other_id", "score"), cols)))


def first_negatives(anchors: pd.DataFrame, rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The ``n`` first rows of each positive's window among the rows of other labels in one block."""
    out = []
    if len(anchors) and len(rows):
        a, b = Side(anchors, "a_"), Side(rows)
        found = anchors.a_positives.to_list()
        for k in range(0, len(a.id), CHUNK):
            low, high = bounds(a.theta[k:k + CHUNK], a.norm[k:k + CHUNK], b.theta, b.norm)
            for i in range(k, k + len(low)):
                spans = [(p, *windows(int(p["score"]))) for p in found[i]]
                meets = np.zeros(len(b.id), bool)
                for _, least, most in spans:
                    if least <= most:
                        meets |= (high[i - k] >= least) & (low[i - k] <= most)
                at = np.flatnonzero(meets & (b.label != a.label[i]) & (b.id != a.id[i]))
                if not len(at):
                    continue
                score = inner(a.v[i], a.norm[i], b.v[at], b.norm[at])
                order = np.lexsort((~b.id[at], score))[::-1]
                ids, score = b.id[at][order], score[order]
                up = score[::-1]
                for p, least, most in spans:
                    x, y = len(up) - np.searchsorted(up, most, "right"), len(up) - np.searchsorted(up, least, "left")
                    y = min(y, x + n)
                    if x < y:
                        m = y - x
                        out.append((np.full(m, a.uid[i]), np.full(m, a.id[i]), np.full(m, p["place"], np.int32),
                                    np.full(m, p["positive_id"]), np.full(m, p["score"]), ids[x:y], score[x:y]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 7
    return pd.DataFrame(dict(zip(("uid", "anchor_id", "place", "positive_id", "positive_score", "other_id", "score"), cols)))


def index(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE, seed: int = 13) -> DataFrame | None:
    """The rows that take part with scaled vector, norm and angles, written; None if there are none."""
    rows = valid(rows)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return None
    rows = rows.where(F.size("v") == length.n)
    some = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).toPandas()
    refs = directions(np.floor(256 * np.stack(some.v.to_list()).astype(float)), references)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.floor(256 * np.stack(pdf.v.to_list()).astype(float))
                yield pdf.assign(v=list(x), norm=norms(x), theta=list(angles(x, refs)))

    return stored(rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "label", "v")
                  .mapInPandas(place, INDEX), "negatives_index")


def mine(rows: DataFrame, anchors=None, positives: int = 5, negatives: int = 10, references: int = REFERENCES,
         block: int = BLOCK, seed: int = 13) -> DataFrame:
    """Hard negatives of the ``anchors`` (a condition on ``vec_id``, by default those divisible by 100) among ``rows``,
    which hold ``vec_id, label, embedding``."""
    spark = rows.sparkSession
    held = index(rows, references, seed=seed)
    if held is None:
        return spark.createDataFrame([], RESULT)
    asked = held.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors)
    n_slots, n_parts = max(1, -(-held.count() // block)), max(1, -(-asked.count() // block))

    def dealt(df, own, n, other, m):
        """Every row in one ``own`` block, with a copy for each ``other`` block."""
        return (df.withColumn(own, F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))

    def meet(anchors, kernel, schema):
        """``kernel`` over every pair of an anchors' block and a rows' block."""
        left = dealt(anchors, "part", n_parts, "slot", n_slots)
        left = left.select(*(F.col(c).alias("a_" + c) for c in left.columns))
        right = dealt(held, "slot", n_slots, "part", n_parts)
        return left.groupBy("a_slot", "a_part").cogroup(right.groupBy("slot", "part")).applyInPandas(kernel, schema)

    found = meet(asked, lambda a, b: best_positives(a, b, positives), PAIRS)
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "other_id"))
    found = (found.withColumn("place", place).where(F.col("place") <= positives).groupBy("uid")
             .agg(F.sort_array(F.collect_list(F.struct("place", F.col("other_id").alias("positive_id"), "score"))).alias("positives")))
    ready = asked.join(stored(found, "negatives_positives"), "uid")
    hits = meet(ready, lambda a, b: first_negatives(a, b, negatives), WINDOWS)
    rank = F.row_number().over(Window.partitionBy("uid", "place").orderBy(F.desc("score"), "other_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def report(rows: DataFrame) -> DataFrame:
    """op13's contract: labels of rows divisible by 7 move on by one, anchors are the rows divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"))


REPORT_SQL = """
WITH r AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

by_value(common, sys.modules[__name__])
