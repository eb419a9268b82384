"""Line hunks: they rebuild the new text, and no shorter script exists."""

import random

from pyspark.sql import functions as F

from chronofold.functions import linediff as ld


def _common(a, b):
    """Length of a longest common sequence, by the textbook table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_minimal_and_exact_with_and_without_halving(monkeypatch):
    rng = random.Random(3)
    for limit in (1 << 27, 1):
        monkeypatch.setattr(ld, "TABLE", limit)
        for _ in range(400):
            a, b = ([rng.choice("abcde") for _ in range(rng.randrange(25))] for _ in range(2))
            m = ld.matches(a, b)
            assert len(m) == _common(a, b) and all(a[i] == b[j] for i, j in m)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
            old, new = "\n".join(a), "\n".join(b)
            assert ld.patch(old, ld.hunks(old, new)) == new


def test_context_and_joined_hunks():
    old = [f"l{i}" for i in range(30)]
    new = old[:5] + ["x"] + old[6:12] + old[13:25] + ["y"] + old[25:]
    h = ld.hunks("\n".join(old), "\n".join(new))
    assert [(x["old_start"], x["old_count"], x["new_start"], x["new_count"]) for x in h] == [(2, 14, 2, 13), (22, 6, 21, 7)]
    assert h[0]["lines"][3:5] == ["-l5", "+x"]


def test_columns_nulls_empty_and_long(spark):
    long = "\n".join(str(i % 700) for i in range(20000))
    rows = [(None, None), (None, ""), ("", None), ("", "a\nb"), ("a\r\nb", "a\nb"), ("a", "a"), (long, long.replace("699", "x")), (None, "a"), ("a\na\na", "a\na")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, old string, new string").withColumn("h", ld.line_hunks("old", "new"))
    got = d.select("i", "new", ld.patched("old", "h").alias("made"), F.size("h").alias("n"), ld.unified(F.col("h")).alias("u")).orderBy("i").collect()
    assert all(r.made == r.new for r in got)
    assert [r.n for r in got[:6]] == [0, 1, 1, 1, 1, 0] and got[6].n == 28 and got[7].u == "@@ -0,0 +1,1 @@\n+a"


def test_a_hunk_of_another_text_is_refused():
    h = ld.hunks("a\nb", "a\nc")
    try:
        ld.patch("a\nx", h)
    except ValueError:
        return
    raise AssertionError
