"""D6/D7 through bit words: equal to the anti join and to a plain loop; what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from runlens import operators as op
from runlens.plans.registry import QUERIES
from conftest import SF_SMALL


def lits(values):
    return F.array(*[F.lit(v) for v in values])


@pytest.mark.parametrize("nodes,reps", [(3, 2), (8, 8), (13, 5), (200, 50), (1, 1)])
def test_equals_a_plain_loop_and_the_anti_join(spark, nodes, reps):
    rng = random.Random(nodes)
    units = [(u,) for u in (None, "a", "a", "b", "hot", "none")]
    dims = {"nodes": list(range(nodes)), "rep": [f"r{k}" for k in range(reps)]}
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "other"]), rng.choice([None, nodes + 5, *dims["nodes"]]),
             rng.choice([None, "x", *dims["rep"]])) for _ in range(60 * 10)]
    present = spark.createDataFrame(rows, "user string, nodes int, rep string").withColumn("extra", F.lit(1))
    frame = spark.createDataFrame(units, "user string")
    cols = {c: lits(v) for c, v in dims.items()}
    got = op.missing_cells(frame, present, ["user"], cols)
    have = set(rows)
    want = sorted(((u, n, r) for (u,) in set(units) for n in dims["nodes"] for r in dims["rep"] if (u, n, r) not in have), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    anti = op.missing_runs(op.expand_grid(frame.distinct(), cols), present, ["user", "nodes", "rep"])
    assert got.dtypes == anti.dtypes and sorted((tuple(r) for r in anti.collect()), key=repr) == want


def test_more_words_than_one_chunk(spark):
    n = 64 * 4096 + 70
    dims = {"a": F.sequence(F.lit(0), F.lit(n // 10)), "b": F.sequence(F.lit(0), F.lit(9))}
    units = spark.range(1).select(F.col("id").alias("u"))
    grid = spark.range((n // 10 + 1) * 10).select(F.lit(0).cast("long").alias("u"), F.floor(F.col("id") / 10).cast("int").alias("a"),
                                                  (F.col("id") % 10).cast("int").alias("b"))
    cut = grid.where("NOT (a = 0 AND b = 0) AND NOT (a = 26214 AND b > 6) AND NOT (a = 13000 AND b = 5)")
    got = op.missing_cells(units, cut, ["u"], dims).where("a IN (0, 13000)").collect()
    assert sorted((r.a, r.b) for r in got) == [(0, 0), (13000, 5)]


def test_empty_tables_and_grids(spark):
    units = spark.createDataFrame([(1,)], "u int")
    none = spark.createDataFrame([], "u int, k int")
    assert [tuple(r) for r in op.missing_cells(units, none, ["u"], {"k": lits([4, 4])}).collect()] == [(1, 4)]
    assert op.missing_cells(none, none, ["u"], {"k": lits([4])}).collect() == []
    empty = F.array().cast("array<int>")
    assert op.missing_cells(units, none, ["u"], {"k": empty}).collect() == []


def test_no_join_and_no_row_per_cell_in_an_exchange(spark):
    df = QUERIES["sweep_missing_cells"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Cartesian" not in text and "Python" not in text
    assert "partial_bit_or" in text
