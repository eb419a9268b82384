"""Helpers in Python hold few rows as objects at once, whatever the batch."""

import pyarrow as pa
from chronofold.functions import linediff, text


def test_rows_become_objects_by_pieces(monkeypatch):
    monkeypatch.setattr(text, "PIECE", 100)

    seen, sizes, whole = [], [], pa.array
    monkeypatch.setattr(text.pa, "array", lambda x, *kind: sizes.append(len(x)) or whole(x, *kind))
    rows = ["x" * 40, None, "", "y" * 500, "z" * 30, "ü" * 30] * 5
    got = text.by_pieces(lambda s: None if s is None else s.upper(), pa.string(), whole(rows))
    assert got.to_pylist() == [None if s is None else s.upper() for s in rows]
    assert 0 < max(sizes) <= 5
    assert len(text.by_pieces(lambda s: seen.append(s), pa.string(), whole([], pa.string()))) == 0 and not seen


def test_hunks_and_patches_of_a_batch_with_nulls(spark):
    rows = [(i, "\n".join(f"l{k}" for k in range(i)), "\n".join(f"l{k}" for k in range(0, i, 2)) if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, old string, new string").withColumn("diff", linediff.line_hunks("old", "new"))
    got = {r["id"]: r for r in df.withColumn("back", linediff.patched("old", "diff")).collect()}
    for i, old, new in rows:
        assert got[i]["back"] == new
        assert [h.asDict() for h in got[i]["diff"]] == ([] if old == new else linediff.hunks(old, new))
