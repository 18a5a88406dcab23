"""op9: nearest neighbours by cosine with an inverted multi-index.

* Fit: two codebooks of ``k`` centroids, one per half of the unit vectors, by Lloyd's rounds on a bounded sample
  (the ``sample`` rows with the smallest seeded hash of their id; the only rows that reach the driver).
* Index: every row goes to the cell (left centroid, right centroid). Cells that hold many rows are dealt out in
  blocks of about ``block`` rows by a hash of the id, so a very common vector does not land in one task.
* Search: each query walks the centroid pairs in order of their summed squared distance, taken off a heap
  that grows along both sorted lists, until the cells passed hold ``visit`` of all rows (the cell sizes, at most
  k * k numbers, are known). ``visit`` is measured, by one rule at every size: ``PROBES`` rows of the sample are searched in it by brute
  force and by the walk, and the share is taken within which ``TARGET`` of their true neighbours lie. In the sample neighbours are no nearer
  than in all rows, so all rows need no larger share. Query and blocks meet by cell; each block returns a query's best rows, reranked
  by the exact cosine of the original vectors in double precision, and the best of all blocks are kept.

With ``visit=1`` the search is exact. Sums run along each row in one fixed order, so equal vectors get equal scores and ties go to
the smaller id.

Defined results: rows whose vector is null, zero, has another length than most of the sample, or holds a null or
non-finite component take no part, nor do rows with a null id; a repeated id is a row of its own except
that a query never finds its own id; fewer than ``n`` candidates give fewer rows; an empty table an empty result.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import by_value, stored

CENTROIDS = 32
SAMPLE = 16384
ROUNDS = 10
TARGET = 0.97
PROBES = 512
BLOCK = 4096
HITS = "query_id long, vec_id long, score double"


def valid(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def codebook(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct seeded rows; an empty centroid stays where it is."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def fit(rows: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 9):
    """(left codebook, right codebook, the sample's unit vectors) or None if no row takes part."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).toPandas()
    if not len(got):
        return None
    dim = int(got.v.map(len).mode()[0])
    x = unit(np.stack([v for v in got.v if len(v) == dim]).astype(float))
    half = (dim + 1) // 2
    return codebook(x[:, :half], k, rounds, seed), codebook(x[:, half:], k, rounds, seed + 1), x


def needed_share(x: np.ndarray, c0: np.ndarray, c1: np.ndarray, n: int, target: float = TARGET, probes: int = PROBES) -> float:
    """Share of the rows ``x`` that a walk has to pass until it holds ``target`` of the probes' ``n`` nearest among them."""
    half = c0.shape[1]
    cell = distances(x[:, :half], c0).argmin(axis=1) * len(c1) + distances(x[:, half:], c1).argmin(axis=1)
    count = dict(zip(*(a.tolist() for a in np.unique(cell, return_counts=True))))
    d0, d1 = distances(x[:probes, :half], c0), distances(x[:probes, half:], c1)
    shares = []
    for i in range(len(d0)):
        near = x @ x[i]
        near[i] = -np.inf
        cells = walk(d0[i], d1[i], count, len(x))
        held = dict(zip(cells, np.cumsum([count[c] for c in cells]).tolist()))
        top = np.argpartition(-near, min(n, len(x)) - 1)[:n]
        shares += [held[c] / len(x) for c in cell[top[near[top] > -np.inf]].tolist()]
    return float(np.quantile(shares, target, method="higher")) if shares else 1.0


def walk(left: np.ndarray, right: np.ndarray, count: dict[int, int], want: float) -> list[int]:
    """Cells in order of ``left[i] + right[j]`` until they hold ``want`` rows: the multi-sequence walk."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out, held = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if count.get(cell):
            out.append(cell)
            held += count[cell]
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))
    return out


def best(q: np.ndarray, q_id: np.ndarray, v: np.ndarray, v_id: np.ndarray, n: int) -> pd.DataFrame:
    """Each query's ``n`` best rows of one block by (exact cosine, smaller id), never its own id."""
    qu, vu = unit(q), unit(v)
    rough = qu @ vu.T
    rough[q_id[:, None] == v_id[None, :]] = -np.inf
    out = []
    length = np.sqrt((v * v).sum(axis=1))
    for i in range(len(q)):
        if len(v) > n:
            floor = np.partition(rough[i], len(v) - n)[len(v) - n]
            at = np.flatnonzero((rough[i] >= floor - 1e-9) & (rough[i] > -np.inf))
        else:
            at = np.flatnonzero(rough[i] > -np.inf)
        score = (v[at] * q[i]).sum(axis=1) / (length[at] * np.sqrt((q[i] * q[i]).sum()))
        odd = ~np.isfinite(score)   # components so large or small that squares leave the range of doubles
        score[odd] = (vu[at][odd] * qu[i]).sum(axis=1)
        top = np.lexsort((v_id[at], -score))[:n]
        out.append(pd.DataFrame({"query_id": np.int64(q_id[i]), "vec_id": v_id[at][top], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(rows: DataFrame, queries: DataFrame, n: int = 5, k: int = CENTROIDS, sample: int = SAMPLE,
           visit: float | None = None, block: int = BLOCK, seed: int = 9) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``rows`` and ``queries`` hold ``vec_id`` and ``embedding``. ``visit`` None: measured."""
    spark = rows.sparkSession
    rows, queries = valid(rows), valid(queries)
    books = fit(rows, k, sample, seed=seed)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c0, c1, x = books
    share = needed_share(x, c0, c1, n) if visit is None else visit
    half, dim = c0.shape[1], c0.shape[1] + c1.shape[1]

    def place(batches):
        for pdf in batches:
            x = unit(np.stack(pdf.v.to_list()).astype(float)) if len(pdf) else np.empty((0, dim))
            cell = distances(x[:, :half], c0).argmin(axis=1) * len(c1) + distances(x[:, half:], c1).argmin(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32))

    fits = F.size("v") == dim
    index = stored(rows.where(fits).mapInPandas(place, "vec_id long, v array<double>, cell int"), "ann_index")
    count = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}   # at most k * k rows
    want = share * sum(count.values())
    n_queries = queries.count()
    q_blocks = max(1, -(-n_queries // block))
    slots = F.create_map(*[F.lit(x) for c, m in sorted(count.items()) if m > block for x in (c, -(-m // block))]
                         ) if any(m > block for m in count.values()) else None
    n_slots = F.coalesce(slots[F.col("cell")], F.lit(1)) if slots is not None else F.lit(1)

    def route(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(np.stack(pdf.v.to_list()).astype(float))
            d0, d1 = distances(x[:, :half], c0), distances(x[:, half:], c1)
            cells = [walk(d0[i], d1[i], count, want) for i in range(len(x))]
            yield pdf.assign(cells=cells)

    routed = queries.where(fits).mapInPandas(route, "vec_id long, v array<double>, cells array<int>")
    asked = (routed.withColumn("cell", F.explode("cells")).drop("cells")
             .withColumn("slot", F.explode(F.sequence(F.lit(0), (n_slots - 1).cast("int"))))
             .withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "vec_id"), F.lit(q_blocks)).cast("int")))
    held = (index.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), n_slots).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best(np.stack(q.v.to_list()).astype(float), q.vec_id.to_numpy(),
                    np.stack(v.v.to_list()).astype(float), v.vec_id.to_numpy(), n)

    keys = ["cell", "slot", "part"]
    hits = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def report(rows: DataFrame) -> DataFrame:
    """op9's contract: every row whose id is divisible by 50, against every other row."""
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


by_value(common, sys.modules[__name__])
