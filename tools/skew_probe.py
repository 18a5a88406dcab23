"""Skew probe: position and predecessor when one group holds every row.

    python tools/skew_probe.py [sf_dir] [copies]

Unions ``copies`` copies of ``lineitem`` under one key, then runs
``with_group_position`` with the plain window (one task sorts the group) and
with the split plan, and prints one JSON line with the seconds of each and
whether their checksums agree. Not a registered query: it measures the hot
path of the position helper.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from runlens.functions import with_group_position  # noqa: E402
from runlens.session import get_spark  # noqa: E402


# A total order (lineitem's (orderkey, linenumber) alone has duplicates).
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "copy"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    spark = get_spark(app="runlens-skew-probe")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet") \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    parts = [li.withColumn("copy", F.lit(i)) for i in range(copies)]
    big = parts[0]
    for p in parts[1:]:
        big = big.unionByName(p)
    big = big.withColumn("k", F.lit(1))
    n_rows = big.count()

    out = {"rows": n_rows, "copies": copies, "sf_dir": sf_dir}
    sums = {}
    for mode in (False, True):
        t0 = time.perf_counter()
        pos = with_group_position(big, ["k"], ORDER,
                                  prev=["l_extendedprice"], skew_safe=mode)
        row = pos.agg(F.sum("pos").alias("s"), F.count("prev_l_extendedprice").alias("c"),
                      F.bit_xor(F.xxhash64("pos", "prev_l_extendedprice")).alias("h")).collect()[0]
        out["split" if mode else "plain"] = round(time.perf_counter() - t0, 2)
        sums[mode] = tuple(row)
        spark.catalog.clearCache()
    out["checksums"] = {"plain": list(sums[False]), "split": list(sums[True])}
    out["same_result"] = sums[False] == sums[True]
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
