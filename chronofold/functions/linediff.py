"""Line differences of two texts: fewest lines removed and added, as hunks with context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import by_pieces

CONTEXT = 3
#: Bits of the match table that a task holds at once (16 MB); longer pairs are halved first.
TABLE = 1 << 27
HUNK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("old_start", "old_count", "new_start", "new_count")] + [T.StructField("lines", T.ArrayType(T.StringType()))])
_HUNKS = pa.list_(pa.struct([(c, pa.int32()) for c in ("old_start", "old_count", "new_start", "new_count")] + [("lines", pa.list_(pa.string()))]))


def _rows(a: list[str], b: list[str]) -> list[int]:
    """For each count of a's lines, the bits of b's lines that don't lengthen the longest common sequence."""
    full, where = (1 << len(b)) - 1, {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    rows = [full]
    for line in a:
        v = rows[-1]
        u = v & where.get(line, 0)
        rows.append((v + u | v - u) & full)
    return rows


def _last(a: list[str], b: list[str]) -> np.ndarray:
    """Common lines of all of a and each beginning of b. Keeps one row of bits."""
    full, where = (1 << len(b)) - 1, {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    v = full
    for line in a:
        u = v & where.get(line, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common sequence of lines, in order. Work is lines times lines over the word size."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0) * (j1 - j0) > TABLE and i1 - i0 > 1:
            mid = (i0 + i1) // 2
            head, tail = _last(a[i0:mid], b[j0:j1]), _last(a[mid:i1][::-1], b[j0:j1][::-1])
            cut = j0 + int(np.argmax(head + tail[::-1]))
            todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
            continue
        rows, i, j = _rows(a[i0:i1], b[j0:j1]), i1 - i0, j1 - j0
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
    return sorted(out)


def hunks(old: str | None, new: str | None, context: int = CONTEXT) -> list[dict]:
    """Changes with the equal lines around them; changes at most two contexts apart share a hunk. Null is no text,
    and has no line; the empty text has one, the empty line. Starts count from 0."""
    a, b = (x.split("\n") if x is not None else [] for x in (old, new))
    edits, i, j = [], 0, 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        if p > i or q > j:
            edits.append((i, p, j, q))
        i, j = p + 1, q + 1
    groups: list[list] = []
    for e in edits:
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for g in groups:
        before = min(context, g[0][0])
        i, j, end = g[0][0] - before, g[0][2] - before, min(len(a), g[-1][1] + context)
        lines, at = [], i
        for i0, i1, j0, j1 in g:
            lines += [" " + x for x in a[at:i0]] + ["-" + x for x in a[i0:i1]] + ["+" + x for x in b[j0:j1]]
            at = i1
        lines += [" " + x for x in a[at:end]]
        out.append({"old_start": i, "old_count": end - i, "new_start": j, "new_count": sum(x[0] != "-" for x in lines), "lines": lines})
    return out


def patch(old: str | None, diff: list[dict]) -> str | None:
    """The new text, from the old one and its hunks. ValueError where a hunk doesn't fit."""
    a, out, at = old.split("\n") if old is not None else [], [], 0
    for h in diff:
        start, kept = h["old_start"], [x[1:] for x in h["lines"] if x[0] != "+"]
        if a[start : start + h["old_count"]] != kept:
            raise ValueError(f"the hunk at line {start} is not of this text")
        out += a[at:start] + [x[1:] for x in h["lines"] if x[0] != "-"]
        at = start + h["old_count"]
    out += a[at:]
    return "\n".join(out) if out else None


@F.arrow_udf(T.ArrayType(HUNK))
def line_hunks(old: pa.Array, new: pa.Array) -> pa.Array:
    """The hunks of each pair of texts; [] for equal texts."""
    return by_pieces(lambda x, y: [] if x == y else hunks(x, y), _HUNKS, old, new)


@F.arrow_udf(T.StringType())
def patched(old: pa.Array, diff: pa.Array) -> pa.Array:
    """Each text with its hunks applied."""
    return by_pieces(patch, pa.string(), old, diff)


def unified(diff):
    """The usual text form of a column of hunks, from a header of counted-from-1 ranges on."""
    first = lambda start, count: F.when(count == 0, start).otherwise(start + 1).cast("string")
    head = lambda h: F.concat(F.lit("@@ -"), first(h["old_start"], h["old_count"]), F.lit(","), h["old_count"].cast("string"), F.lit(" +"), first(h["new_start"], h["new_count"]), F.lit(","), h["new_count"].cast("string"), F.lit(" @@"))
    return F.array_join(F.transform(diff, lambda h: F.concat(head(h), F.lit("\n"), F.array_join(h["lines"], "\n"))), "\n")
