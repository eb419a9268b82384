"""Substring deduplication of word windows by relative Lempel-Ziv parsing.

A window is WINDOW consecutive words. Every word of a document that is covered by a window which also
starts in a document with a smaller doc_id goes; windows are judged on the input.

1. Texts are cut into phrases at content-defined places: the consecutive windows that share one anchor,
   the smallest hash of a GRAM-word string in the window. Equal windows have equal anchors, so a copied
   passage falls into the same phrases wherever it stands.
2. The reference is every document's phrases, dealt to REFERENCE_BLOCKS blocks by the anchor. A block is
   indexed by its phrases' hashes, each with its first place (smallest doc_id). Partial aggregation leaves one
   entry for each phrase and task, so a passage that a third of all documents share is a row per task.
3. All documents' phrases are looked up in one block after another; then each document is factored greedily
   from left to right: a factor goes on as long as the next phrase's place continues the same reference document.
4. At the boundaries of factors phrases differ, but windows may still be equal: in a phrase's first document, all its
   places whose anchor has several phrases are looked up again window by window. They lengthen factors or become
   new ones.

A phrase holds a whole window or more, so every factor is long enough to be a duplicate span.

Phrases and windows are compared by 64-bit hashes of their words. A null text has no words; texts shorter
than a window lose nothing, nor do rows without a doc_id, which are no reference either. Rows that share a
doc_id, equal or not, don't remove each other's words; each is judged by itself against smaller doc_ids.
Very long texts are read in blocks of words; a phrase cut by a block's end is settled in step 4. An empty
table gives no rows; other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _B, _BINV, _powers, byte_rows, col, cut, mix, nonspace_bytes, pieces, span_hash, uncut, word_spans

WINDOW = 13
GRAM = 6
#: Words handled at once.
BLOCK = 1 << 18
#: Reference blocks, indexed one after another; more of them take less disk at a time.
REFERENCE_BLOCKS = 4
_LOW = np.uint64((1 << 20) - 1)
_SALT = np.uint64(0xA0761D6478BD642F)

# A place in one number: 32 bits of the text's hash, which tell apart rows that share a doc_id, then the
# first window's start and the number of windows.
START, COUNT, TEXT = 27, 4, 31


def _sequence_hash(words: np.ndarray):
    """A function of (starts, ends) to hashes of words[start:end]."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_B, n + 1)[:n], out=sums[1:])
    inverse = _powers(_BINV, n + 1)
    return lambda s, e: mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))


def phrases(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, count, anchor, phrase) of all phrases, in blocks. words: hashes of all rows' words; first: the n + 1
    offsets of rows. start is among all words; phrases never cross rows."""
    n = len(words) - window + 1
    open_ = np.zeros(max(n, 0) + 1, bool)
    for lo, hi in zip(first[:-1], first[1:]):
        open_[lo : max(lo, hi - window + 1)] = True
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = words[lo : hi + window - 1]
        whole = _sequence_hash(part)
        at = np.arange(len(part) - gram + 1)
        g = whole(at, at + gram)
        # The smallest gram hash of each window and its place in one number; the leftmost of equals.
        v = (mix(g ^ _SALT) & ~_LOW) | at.astype(np.uint64)
        width, span = window - gram + 1, 1
        while span * 2 <= width:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        v = np.minimum(v[: hi - lo], v[width - span : width - span + hi - lo])
        anchor = (v & _LOW).astype(np.int64)
        live = open_[lo:hi]
        # A row's last window and the next row's first one never share a phrase: the windows between are closed.
        change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (live[1:] != live[:-1])])
        new = np.flatnonzero(change)
        count = np.diff(np.append(new, hi - lo))
        new, count = new[live[new]], count[live[new]]
        yield new + lo, count, g[anchor[new]], mix(whole(new, new + count + window - 1) ^ _SALT)


def _hashed_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    body, at = byte_rows(col(batch, "text"))
    starts, ends, first = word_spans(body, at, nonspace_bytes())
    return span_hash(body, starts, ends), first


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _place(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return text << TEXT | start << COUNT | count


def _phrase_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, place, anchor, phrase) of every phrase of docs(doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 21):
            words, first = _hashed_words(batch)
            doc, text = (col(batch, c).to_numpy() for c in ("doc_id", "text_hash"))
            for start, count, anchor, phrase in phrases(words, first, window):
                row = np.searchsorted(first, start, "right") - 1
                place = _place(text[row], start - first[row], count)
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(place), _int64(anchor), _int64(phrase)], ["doc_id", "place", "anchor", "phrase"])

    return docs.mapInArrow(run, "doc_id long, place long, anchor long, phrase long")


def _window_rows(asked: DataFrame, window: int) -> DataFrame:
    """(doc_id, place, digit) of every window in the places asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 21):
            words, first = _hashed_words(batch)
            text, places = col(batch, "text_hash").to_numpy(), col(batch, "places")
            out = []
            for k, doc in enumerate(col(batch, "doc_id").to_pylist()):
                p = np.unique(places[k].values.to_numpy())
                p = p[p >> TEXT == text[k]]
                start, count = p >> COUNT & (1 << START) - 1, p & (1 << COUNT) - 1
                s = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                for lo in range(0, len(s), BLOCK):
                    part = s[lo : lo + BLOCK]
                    own = words[first[k] + part[0] : first[k] + part[-1] + window]
                    digit = _sequence_hash(own)(part - part[0], part - part[0] + window)
                    out.append((np.full(len(part), doc), _place(text[k], part, np.ones(len(part), np.int64)), digit))
            if out:
                d, p, w = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), _int64(w)], ["doc_id", "place", "digit"])

    return asked.select("doc_id", "text_hash", "text", "places").mapInArrow(run, "doc_id long, place long, digit long")


def factors(start: np.ndarray, count: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, reference document, reference start) of one document, from its matched places in
    any order. A factor goes on while the next place overlaps or touches it and continues the same reference."""
    order = np.lexsort((-count, start))
    out: list[list[int]] = []
    for s, c, d, r in zip(start[order].tolist(), count[order].tolist(), ref_doc[order].tolist(), ref_start[order].tolist()):
        end = s + c + window - 1
        if out and d == out[-1][2] and r - s == out[-1][3] - out[-1][0] and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([s, end, d, r])
    return [(s, e - s, d, r) for s, e, d, r in out]


def _look_up(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One reference block, indexed, and all documents' phrases looked up in it: (doc_id, place, ref_doc, ref_place) of
    those that start in a smaller doc_id, and (doc_id, place) of all places in a phrase's first document, where its
    anchor has other phrases: the phrase may stand there several times, and in several rows of that doc_id."""
    index = found.groupBy("phrase").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("ref_place"), F.first("anchor").alias("anchor"))
    index = cut(index)
    mixed = index.groupBy("anchor").agg(F.min("phrase").alias("a"), F.max("phrase").alias("b"), F.min("ref_doc").alias("c"), F.max("ref_doc").alias("d")).filter("a < b and c < d")
    asked = index.join(mixed.select("anchor", F.lit(True).alias("mixed")), "anchor", "left").filter("mixed or last > ref_doc").select("phrase", "ref_doc", "ref_place", "mixed")
    met = cut(found.select("phrase", "doc_id", "place").join(asked, "phrase").filter("doc_id > ref_doc or mixed").select("doc_id", "place", "ref_doc", "ref_place"), index)
    return met.filter("doc_id > ref_doc"), met.filter("doc_id = ref_doc").select("doc_id", "place")


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_words, n_removed, kept_sha256, n_factors, longest[, kept, spans]).

    n_factors counts the document's factors, longest has the words of the longest one; kept is the text that stays
    (words joined by one space), spans the factors as (start, words, ref_doc, ref_start)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    keyed = docs.select("doc_id", F.coalesce(F.xxhash64("text").bitwiseAND(0xFFFFFFFF), F.lit(0)).alias("text_hash"), "text")
    found = cut(_phrase_rows(keyed.filter("doc_id is not null and text is not null"), window))
    blocks = [_look_up(found.filter(F.pmod("anchor", F.lit(REFERENCE_BLOCKS)) == b)) for b in range(REFERENCE_BLOCKS)]
    uncut(found)
    matched, open_ = (reduce(DataFrame.union, x) for x in zip(*blocks))
    places = open_.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    windows = cut(_window_rows(keyed.join(places, "doc_id"), window))
    firsts = windows.groupBy("digit").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("ref_place")).filter("last > ref_doc").drop("last")
    single = cut(windows.join(firsts, "digit").filter("doc_id > ref_doc").select("doc_id", "place", "ref_doc", "ref_place"), windows)
    marks = matched.union(single).groupBy("doc_id").agg(F.collect_list(F.struct("place", "ref_doc", "ref_place")).alias("marks"))
    joined = keyed.join(marks, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 22):
            body, at = byte_rows(col(batch, "text"))
            starts, ends, first = word_spans(body, at, nonspace_bytes())
            text, marks = col(batch, "text_hash").to_numpy(), col(batch, "marks")
            rows = []
            for k, doc in enumerate(col(batch, "doc_id").to_pylist()):
                n = int(first[k + 1] - first[k])
                gone, parsed = np.zeros(n + 1, np.int64), []
                if marks[k].is_valid:
                    m = marks[k].values
                    place, ref_doc, ref = (m.field(c).to_numpy() for c in ("place", "ref_doc", "ref_place"))
                    own = place >> TEXT == text[k]
                    place, ref_doc, ref = place[own], ref_doc[own], ref[own]
                    start, count = place >> COUNT & (1 << START) - 1, place & (1 << COUNT) - 1
                    parsed = factors(start, count, ref_doc, ref >> COUNT & (1 << START) - 1, window)
                    for s, size, _, _ in parsed:
                        gone[s] += 1
                        gone[s + size] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:n]) == 0) + first[k]
                kept = b" ".join([body[s:e].tobytes() for s, e in zip(starts[stay].tolist(), ends[stay].tolist())])
                more = [kept.decode(), [dict(zip(("start", "words", "ref_doc", "ref_start"), f)) for f in parsed]] if with_text else []
                rows.append((doc, n, n - len(stay), hashlib.sha256(kept).hexdigest(), len(parsed), max((f[1] for f in parsed), default=0), *more))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, longest long"
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "longest"]
    if with_text:
        span = "start long, words long, ref_doc long, ref_start long"
        kinds += [pa.string(), pa.list_(pa.struct([(x.split()[0], pa.int64()) for x in span.split(", ")]))]
        schema += f", kept string, spans array<struct<{span.replace(' long', ': long')}>>"
        names += ["kept", "spans"]
    return joined.select("doc_id", "text_hash", "text", "marks").mapInArrow(run, schema)
