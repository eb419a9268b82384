"""License scans: exact notices by word position, fuzzy short notices by pigeonhole seeds.

A notice within `errors` edits of a phrase contains one of the phrase's `errors + 1` pieces
unchanged (pigeonhole), so exact piece hits locate every candidate; the `regex` library's
bounded-error matching then verifies the candidate and reports its span. Nulls and texts
without words give zero places, null positions and empty labels; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import alnum_bytes, ascii_lower, byte_rows, col, pieces, span_hash, word_spans

# Phrases and labels of the exact scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, n_fuzzy long, fuzzy_spans array<struct<label:string,start:long,end:long,edits:int>>"
)


def allowed_edits(phrase: str) -> int:
    """One edit for each ten letters; phrases under ten letters only match exactly."""
    return len(phrase) // 10


class _Fuzzy:
    def __init__(self, phrases: dict[str, str]):
        self.ok = alnum_bytes()
        self.items = []
        for phrase, label in phrases.items():
            edits = allowed_edits(phrase)
            if not edits:
                continue
            n = edits + 1
            cuts = [round(i * len(phrase) / n) for i in range(n + 1)]
            seeds = [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:])]
            # Word bounds are part of the pattern, so the best match among those at word bounds is returned.
            word = rb"[0-9A-Za-z\x80-\xff]"
            pattern = regex.compile(rb"(?b)(?<!%s)(?=%s)(?:%s){e<=%d}(?<=%s)(?!%s)" % (word, word, regex.escape(phrase, literal_spaces=True).encode(), edits, word, word))
            self.items.append((phrase, label, edits, seeds, pattern))

    def spans(self, text: bytes) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of places within the allowed edits, by byte, that start and end at word bounds."""
        found = []
        for phrase, label, edits, seeds, pattern in self.items:
            windows = []
            for offset, seed in seeds:
                i = text.find(seed)
                while i >= 0:
                    windows.append((max(0, i - offset - edits), min(len(text), i - offset + len(phrase) + edits)))
                    i = text.find(seed, i + 1)
            last = -1
            for lo, hi in sorted(set(windows)):
                if hi <= last:
                    continue
                m = pattern.search(text, max(lo - 1, last, 0), hi + 1)  # one byte more on each side, for the bounds
                if not m or m.end() == m.start():
                    continue
                s, e = m.span()
                inner = (s and self.ok[text[s - 1]]) or (e < len(text) and self.ok[text[e]]) or not self.ok[text[s]] or not self.ok[text[e - 1]]
                if not inner:
                    found.append((label, s, e, sum(m.fuzzy_counts)))
                    last = e
        return found


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of docs(doc_id, text): exact places, labels, fuzzy spans and a score."""
    split = [(p.split(" "), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy, ok = _Fuzzy(phrases), alnum_bytes()
        keys = {w: int(_one_hash(w)) for words, _ in split for w in words}
        for batch in pieces(batches, "text"):
            raw, at = byte_rows(col(batch, "text"))
            body = ascii_lower(raw)
            s, e, first = word_spans(body, at, ok)
            h = span_hash(body, s, e)
            n = batch.num_rows
            row_end = np.repeat(first[1:], np.diff(first))
            hits: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for words, label in split:
                k = len(words)
                if len(h) < k:
                    continue
                where = np.flatnonzero(h[: len(h) - k + 1] == np.uint64(keys[words[0]]))
                for j in range(1, k):
                    where = where[h[where + j] == np.uint64(keys[words[j]])]
                where = where[where + k <= row_end[where]]
                for w, r in zip(where.tolist(), (np.searchsorted(first, where, "right") - 1).tolist()):
                    hits[r].append((w - int(first[r]), label))
            text = body.tobytes()
            out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_fuzzy", "fuzzy_spans")}
            for r in range(n):
                base = {x for _, x in hits[r]}
                near = fuzzy.spans(text[at[r] : at[r + 1]])
                places = [w for w, _ in hits[r]]
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {x[0] for x in near})))
                out["score"].append(1.0 if base else max([1.0 - 0.25 * x[3] for x in near], default=0.0))
                inexact = [{"label": a, "start": b, "end": c, "edits": d} for a, b, c, d in near]
                out["n_fuzzy"].append(sum(x["edits"] > 0 for x in inexact))
                out["fuzzy_spans"].append(inexact)
            types = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_fuzzy": pa.int64(), "fuzzy_spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))}
            yield pa.RecordBatch.from_arrays(
                [col(batch, "doc_id").cast(pa.int64()), pa.array(np.diff(first))] + [pa.array(out[k], types[k]) for k in types],
                ["doc_id", "n_words", *types],
            )

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, SCHEMA)


def _one_hash(word: str) -> np.uint64:
    body = np.frombuffer(word.encode(), np.uint8)
    return span_hash(body, np.array([0]), np.array([len(body)]))[0]
