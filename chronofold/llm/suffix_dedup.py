"""Suffix-array deduplication of repeated byte windows by depth-limited radix sort.

Only the first WINDOW bytes of suffixes are ever compared: two suffixes are equal when their windows
are. Suffixes are radix-sorted from the most significant digit on, and a group leaves the sort as soon
as it is alone:

1. first digit: the GRAM-byte string at the window's anchor, the smallest hash in the window, a
   content-defined place that equal windows share. Runs of suffixes with one anchor travel as one
   entry, so the shuffle holds an entry for about every 35 bytes, not for every byte;
2. second digit: the whole run of windows. Equal runs are equal windows; the first place stays, all
   other places are repeats, without another look;
3. third digit: only in anchor groups that still hold different runs, runs split into chunks of up to
   CHUNK windows at fixed distances from the anchor. The bytes that all windows of a chunk share are
   its group; equal chunks of a group are equal windows;
4. last digit: the single window, only in chunk groups that still hold different chunks, as a rule
   beside an edit. Equal groups are exactly the repeated windows.

Groups shrink before every shuffle: repeats inside a document never leave it, and partial aggregation
leaves one entry for each group and task, so a passage that a third of all documents share costs one
row per task. What returns to a document is the list of its first places; every other window in it is
a repeat.

Digits are 64-bit hashes that are compared together with the digits before them. Nulls and texts
shorter than WINDOW lose nothing, nor do rows without a doc_id. Equal rows are treated alike: neither
removes the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _B, _BINV, _powers, byte_rows, col, cut, mix, pieces

WINDOW = 100
GRAM = 24
#: Windows of a chunk.
CHUNK = 8
#: Suffixes handled at once.
BLOCK = 1 << 18
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _rolling(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any span comes, and the inverse powers."""
    n = len(body)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers(_B, n + 1)[:n], out=sums[1:])
    return sums, _powers(_BINV, n + 1)


def _hash(sums: np.ndarray, inverse: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))


def runs(text: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (start, number of windows, anchor's distance, anchor digit, run digit), in order, that cover all
    windows of a text."""
    n = len(text) - window + 1
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        body = text[lo : hi + window - 1]
        sums, inverse = _rolling(body)
        grams = len(body) - gram + 1
        at = np.arange(grams)
        g = _hash(sums, inverse, at, at + gram)
        # The smallest gram hash of each window and its place in one number; the leftmost of equals.
        low = np.uint64((1 << 20) - 1)
        v = (mix(g ^ _SALT) & ~low) | at.astype(np.uint64)
        width = window - gram + 1
        span = 1
        while span * 2 <= width:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        v = np.minimum(v[: hi - lo], v[width - span : width - span + hi - lo])
        anchor = (v & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(new, hi - lo))
        whole = _hash(sums, inverse, new, new + count + window - 1)
        yield new + lo, count, anchor[new] - new, g[anchor[new]], mix(whole ^ _SALT)


def _firsts_in(keys: list[np.ndarray]) -> np.ndarray:
    """Indices of the first row with each combination of keys, in order."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    new[1:] = ~same
    return np.sort(order[new])


def _place(start: np.ndarray, count: np.ndarray, distance: np.ndarray | int = 0) -> np.ndarray:
    """Neighbouring windows in one number: the first one's start, how many, and their anchor's distance from it."""
    return start << 16 | count << 8 | distance


def _levels(docs: DataFrame, schema: str, entries) -> DataFrame:
    """(group, digit, doc_id, place) of each row by entries(text, row) -> (group, digit, place), the first of equal
    ones in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 21):
            body, at = byte_rows(col(batch, "text"))
            asked = col(batch, "places") if "places" in batch.schema.names else [None] * batch.num_rows
            out = []
            for k, (doc, places) in enumerate(zip(col(batch, "doc_id").to_pylist(), asked)):
                if doc is None:
                    continue
                for group, digit, place in entries(body[at[k] : at[k + 1]], places):
                    out.append((group, digit, np.full(len(group), doc), place))
            if out:
                g, x, d, p = (np.concatenate(x) for x in zip(*out))
                keep = _firsts_in([d.astype(np.uint64), g, x])
                yield pa.RecordBatch.from_arrays([pa.array(g[keep].view(np.int64)), pa.array(x[keep].view(np.int64)), pa.array(d[keep].astype(np.int64)), pa.array(p[keep])], ["group", "digit", "doc_id", "place"])

    return docs.mapInArrow(run, schema)


def _split(places: pa.ListScalar, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """A row's places in order, in blocks: (first byte, end, starts, counts, distances)."""
    wanted = np.sort(places.values.to_numpy())
    s, c, d = wanted >> 16, wanted >> 8 & 255, wanted & 255
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(s, s[i] + BLOCK)))
        yield int(s[i]), int((s[i:j] + c[i:j]).max()) + window - 1, s[i:j], c[i:j], d[i:j]
        i = j


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the index of each of n.sum() elements, and its number within its index."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _chunks(text: np.ndarray, places: pa.ListScalar, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The third digit of the given runs: (shared bytes, whole chunk, place)."""
    for lo, hi, s, c, d in _split(places, window):
        sums, inverse = _rolling(text[lo:hi])
        low = (d - c + 1) // CHUNK
        i, k = _spread(d // CHUNK - low + 1)
        # The chunk's last possible window; chunks at a run's ends hold fewer.
        top = (s + d)[i] - CHUNK * (low[i] + k)
        first, last = np.maximum(s[i], top - CHUNK + 1), np.minimum((s + c)[i] - 1, top)
        shared = _hash(sums, inverse, top - lo, top - lo + window - CHUNK + 1)
        yield shared, mix(_hash(sums, inverse, first - lo, last - lo + window) ^ _SALT), _place(first, last - first + 1)


def _singles(text: np.ndarray, places: pa.ListScalar, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The last digit of the given chunks: (first half, second half, place) of every window."""
    for lo, hi, s, c, _ in _split(places, window):
        sums, inverse = _rolling(text[lo:hi])
        i, k = _spread(c)
        at, half = s[i] + k - lo, window // 2
        yield _hash(sums, inverse, at, at + half), mix(_hash(sums, inverse, at + half, at + window) ^ _SALT), _place(at + lo, np.ones(len(at), np.int64))


def _kept_mask(text: np.ndarray, fresh: np.ndarray, window: int) -> np.ndarray:
    """Bytes outside all repeated windows: those that are in none of the places in `fresh`."""
    n = len(text)
    if n < window:
        return np.ones(n, bool)
    delta = np.zeros(n - window + 2, np.int32)
    np.add.at(delta, fresh >> 16, 1)
    np.add.at(delta, (fresh >> 16) + (fresh >> 8 & 255), -1)
    again = np.concatenate([np.cumsum(delta[:-1]) == 0, np.zeros(window - 1, bool)])
    reach = np.concatenate([[0], np.cumsum(again)])
    lo = np.maximum(np.arange(n) - window + 1, 0)
    return reach[1:] == reach[lo]


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): every byte covered by a
    window-byte string that also starts earlier (smaller doc_id, or same row, earlier start) is removed."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    entry = "group long, digit long, doc_id long, place long"

    def sort_pass(source: DataFrame, entries) -> tuple[DataFrame, DataFrame]:
        """First places of each (group, digit), and those of them whose group holds other digits.
        Each is written before the next pass starts, so that no two passes' shuffles are on disk together."""
        firsts = cut(_levels(source, entry, entries).groupBy("group", "digit").agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place")))
        mixed = firsts.groupBy("group").agg(F.count("*").alias("c")).filter("c > 1").select("group")
        return firsts, cut(firsts.join(mixed, "group", "left_semi").select("doc_id", "place"))

    def asked(places: DataFrame) -> DataFrame:
        lists = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        return docs.join(lists, "doc_id").select("doc_id", "text", "places")

    whole_runs = lambda text, _: ((a, r, _place(s, c, d)) for s, c, d, a, r in (runs(text, window) if len(text) >= window else ()))
    firsts, open_runs = sort_pass(docs, whole_runs)
    chunks, open_chunks = sort_pass(asked(open_runs), lambda text, places: _chunks(text, places, window))
    singles, _ = sort_pass(asked(open_chunks), lambda text, places: _singles(text, places, window))
    # Everything a document needs to know, in one list: windows that are first places are even, and odd where
    # a later digit decides.
    tagged = [(firsts, 0), (open_runs, 1), (chunks, 0), (open_chunks, 1), (singles, 0)]
    marks = reduce(DataFrame.union, [df.select("doc_id", (F.col("place") * 2 + odd).alias("mark")) for df, odd in tagged])
    marks = marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    joined = docs.join(marks, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 22):
            body, at = byte_rows(col(batch, "text"))
            rows = []
            for k, (doc, m) in enumerate(zip(col(batch, "doc_id").to_pylist(), col(batch, "marks"))):
                text = body[at[k] : at[k + 1]]
                m = m.values.to_numpy() if m.is_valid else np.zeros(0, np.int64)
                # A place that is open goes once: a run and a chunk, or a chunk and a window, can be alike.
                closed, n = np.unique(np.sort(m >> 1), return_counts=True)
                odd, n_odd = np.unique((m >> 1)[m & 1 == 1], return_counts=True)
                n[np.searchsorted(closed, odd)] -= 2 * n_odd
                keep = _kept_mask(text, closed[n > 0], window) if doc is not None else np.ones(len(text), bool)
                edge = np.diff(np.concatenate([[True], keep]).astype(np.int8))
                kept = text[keep].tobytes()
                rows.append((doc, len(text), len(text) - len(kept), int((edge < 0).sum()), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [x.split()[0] for x in schema.split(", ")]
    return joined.select("doc_id", "text", "marks").mapInArrow(run, schema)
