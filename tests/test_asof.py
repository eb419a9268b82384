"""The as-of join against a plain version."""

import random

from chronofold.functions import temporal as tp


def test_as_of_join_of_any_windows_meets_no_pairs_of_one_key(spark):
    """Windows that overlap, follow each other, are empty or open; null keys and dates; many rows of one key."""
    r = random.Random(5)
    windows = []
    for i in range(120):
        a = r.randrange(60)
        windows.append((r.choice([1, 2, 3, None]), a if i % 30 else None, r.choice([None, a + r.randrange(25)]) if a % 4 == 0 else a + r.randrange(6), i))
    left = [(i, r.choice([1, 2, 3, 4, None]), r.choice([None, *range(70)])) for i in range(300)]
    left += left[:5]
    right = spark.createDataFrame(windows, "k int, valid_from int, valid_to int, id int")
    got = tp.as_of_join(spark.createDataFrame(left, "n int, k int, at int"), right, ["k"], "at")

    def plain(k, at):
        met = [(s, s, -1 if e is None else e, i) for q, s, e, i in windows if None not in (k, at, s) and q == k and s <= at and (e is None or at < e)]
        return max(met)[3] if met else None

    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in got.select("n", "k", "at", "id").collect()), key=key) == sorted(((n, k, at, plain(k, at)) for n, k, at in left), key=key)
    ends = spark.createDataFrame([(1, a, a + 1, a) for a in range(50)], "k int, valid_from int, valid_to int, id int")
    plan = tp.as_of_join(spark.createDataFrame(left, "n int, k int, at int"), ends, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
