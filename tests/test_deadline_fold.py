"""The deadline processor's fold gives the same minima and member table however a job's rows are cut into frames."""

import random

import numpy as np
import pandas as pd

from runlens.streaming import deadline


def _frame(rnd: random.Random, n: int) -> pd.DataFrame:
    us = [None if rnd.random() < 0.05 else rnd.randint(0, 10**12) for _ in range(n)]
    member = [None if rnd.random() < 0.05 else f"m{rnd.randint(0, 30)}" for _ in range(n)]
    expected = [None if rnd.random() < 0.1 else rnd.randint(1, 9) for _ in range(n)]
    failed = [rnd.random() < 0.1 for _ in range(n)]
    return pd.DataFrame({"job": np.ones(n, dtype="int64"),
                         "us": pd.array(us, dtype="Int64").astype("float64"),
                         "member": member, "expected": pd.array(expected, dtype="Int64").astype("float64"),
                         "failed": failed})


def test_fold_does_not_depend_on_frames():
    rnd = random.Random(5)
    for n in (0, 1, 40, 1500):
        whole = _frame(rnd, n)
        a, b = deadline._Fold(), deadline._Fold()
        a.add(whole)
        for i in range(0, n, 100):
            b.add(whole.iloc[i:i + 100])
        assert (a.start, a.expected, a.failed, a.firsts) == (b.start, b.expected, b.failed, b.firsts)
        seen = whole[whole["us"].notna()]
        firsts = seen[seen["member"].notna()].groupby("member")["us"].min()
        assert a.firsts == {m: int(v) for m, v in firsts.items()}
