"""Randomised checks: many generated cases per Spark job."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens import operators as op
from runlens.functions import with_group_position


def _pad(n, w):
    s = str(n)
    return s if len(s) >= w else "0" * (w - len(s)) + s


@settings(max_examples=3, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_hostlist_matches_direct_generation(spark, seed):
    rnd = random.Random(seed)
    rows, expected = [], set()
    for alloc in range(60):
        items, hosts = [], set()
        for _ in range(rnd.randint(1, 3)):
            prefix = rnd.choice(["c", "node", "gpu-", "r1n"])
            if rnd.random() < 0.3:
                name = f"{prefix}{rnd.randint(0, 99)}"
                items.append(name)
                hosts.add(name)
                continue
            if rnd.random() < 0.2:   # two bracket groups: their product
                a, b = rnd.randint(0, 5), rnd.randint(0, 20)
                items.append(f"{prefix}[{a}-{a + 1}]-s[{_pad(b, 2)}-{_pad(b + 2, 2)}]")
                hosts.update(f"{prefix}{i}-s{_pad(j, 2)}" for i in (a, a + 1) for j in range(b, b + 3))
                continue
            width = rnd.choice([1, 2, 3])
            ranges = []
            for _ in range(rnd.randint(1, 3)):
                lo = rnd.randint(0, 120)
                hi = lo + rnd.randint(0, 6)
                if rnd.random() < 0.5:
                    ranges.append(f"{_pad(lo, width)}-{_pad(hi, width)}")
                    hosts.update(f"{prefix}{_pad(n, width)}" for n in range(lo, hi + 1))
                else:
                    ranges.append(_pad(lo, width))
                    hosts.add(f"{prefix}{_pad(lo, width)}")
            items.append(f"{prefix}[{','.join(ranges)}]")
        rows.append((alloc, ",".join(items)))
        expected.update((alloc, h) for h in hosts)
    df = spark.createDataFrame(rows, "alloc_id int, expr string")
    got = {(r.alloc_id, r.host) for r in op.expand_hostlist(df).collect()}
    assert got == expected


@settings(max_examples=3, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.sampled_from([1, 3, 8, 13]))
def test_group_position_equals_window_with_hot_key(spark, seed, parts):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        key = 0 if rnd.random() < 0.35 else rnd.randint(1, 40)   # one key holds a third
        if rnd.random() < 0.01:
            key = None
        rows.append((key, rnd.randint(0, 500), i))
    df = spark.createDataFrame(rows, "k int, t int, id int")
    fast = with_group_position(df, ["k"], [F.col("t"), F.col("id")], prev=["t"], first=["id"],
                               num_partitions=parts, skew_safe=True, size_col="size")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("prev_t", F.lag("t").over(w)) \
        .withColumn("first_id", F.first("id").over(w)) \
        .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("k")))
    cols = ["k", "t", "id", "pos", "prev_t", "first_id", "size"]
    a = sorted((tuple(r) for r in fast.select(*cols).collect()), key=repr)
    b = sorted((tuple(r) for r in ref.select(*cols).collect()), key=repr)
    assert a == b


def test_dense_ids_are_zero_to_n_minus_one(spark):
    rnd = random.Random(7)
    rows = [(f"a{rnd.randint(0, 5)}", f"h{rnd.randint(0, 300)}") for _ in range(4000)]
    df = spark.createDataFrame(rows, "alloc_id string, host string")
    ids = op.assign_ids(df, skew_safe=True).groupBy("alloc_id").agg(
        F.count("*").alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"),
        F.countDistinct("node_id").alias("d"), F.sum(F.col("is_master").cast("int")).alias("m"))
    for r in ids.collect():
        assert (r.lo, r.hi, r.d, r.m) == (0, r.n - 1, r.n, 1)


def test_exact_percentiles_match_spark_percentile(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", "c"]), round(rnd.uniform(0, 100), 2)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double")
    ours = {r.g: (r.p50, r.p90) for r in op.run_stats(df, ["g"], "v", percentiles=(0.5, 0.9),
                                                      skew_safe=True).collect()}
    ref = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("v", [0.5, 0.9]).alias("p")).collect()}
    for g, (p50, p90) in ours.items():
        assert abs(p50 - ref[g][0]) < 1e-9 and abs(p90 - ref[g][1]) < 1e-9


def test_group_position_schema_is_the_same_on_both_plans(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 3, 2), (2, 7, 3)], "k int, t int, id int")
    plain = with_group_position(df, ["k"], ["t", "id"], prev=["t"], first=["id"], skew_safe=False,
                                size_col="size")
    split = with_group_position(df, ["k"], ["t", "id"], prev=["t"], first=["id"], skew_safe=True,
                                size_col="size")
    assert plain.dtypes == split.dtypes
    assert dict(plain.dtypes)["pos"] == "bigint"
    spark.catalog.clearCache()


def test_long_ranges_cross_chunks(spark):
    from runlens.operators.hosts import RANGE_CHUNK
    hi = 2 * RANGE_CHUNK + 37
    expr = f"r[00{RANGE_CHUNK - 3}-{hi}],s[1-{RANGE_CHUNK}],m[1-{hi}]-z[1-2,7]"
    df = spark.createDataFrame([(1, expr)], "alloc_id int, expr string")
    got = {r.host for r in op.expand_hostlist(df).collect()}
    width = len(f"00{RANGE_CHUNK - 3}")
    want = {f"r{str(i).zfill(width)}" for i in range(RANGE_CHUNK - 3, hi + 1)} \
        | {f"s{i}" for i in range(1, RANGE_CHUNK + 1)} \
        | {f"m{i}-z{j}" for i in range(1, hi + 1) for j in (1, 2, 7)}
    assert got == want


def test_multi_group_items_match_their_product(spark):
    """Items with 1-6 bracket groups."""
    import itertools
    rnd = random.Random(23)
    rows, expected = [], set()
    for alloc in range(40):
        n_groups = rnd.randint(1, 6)
        texts = [rnd.choice(["r", "n", "-x", ""]) for _ in range(n_groups + 1)]
        groups, values = [], []
        for _ in range(n_groups):
            lo, w = rnd.randint(0, 9), rnd.choice([1, 2])
            hi = lo + rnd.randint(0, 2)
            groups.append(f"{_pad(lo, w)}-{_pad(hi, w)}")
            values.append([_pad(v, w) for v in range(lo, hi + 1)])
        item = texts[0] + "".join(f"[{g}]{t}" for g, t in zip(groups, texts[1:]))
        if item.startswith("["):
            item = "h" + item
            texts[0] = "h" + texts[0]
        rows.append((alloc, item))
        for combo in itertools.product(*values):
            expected.add((alloc, texts[0] + "".join(v + t for v, t in zip(combo, texts[1:]))))
    df = spark.createDataFrame(rows, "alloc_id int, expr string")
    got = {(r.alloc_id, r.host) for r in op.expand_hostlist(df).collect()}
    assert got == expected
