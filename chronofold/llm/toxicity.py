"""Toxicity by noisy-channel deobfuscation.

Words disguised by leetspeak, spacing or repetition become character lattices: a sign stands for one of
its letters, a run of a letter for one or two of it, spaced letters for one word or several. Viterbi search over
states of two letters finds the likeliest readings, exactly, under a character trigram model counted over all documents.
The readings join the text, and the restored text is scored by words and word beginnings that training
documents of label 1 have and others lack; scores are calibrated to probabilities on training rows.

Null and empty texts get the score of a text without any such word. Without labels every score is 0.
Labels that repeat for a document count once (the larger); null labels are no labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_bytes, col, cut, pieces, span_hash, word_spans

#: The classifier is fitted on about this many labelled documents at most, drawn by hash of the id.
SAMPLE_ROWS = 20_000
#: A word counts from this many training documents of label 1 on, or from this share of them if that is more.
LEAST_DOCS, LEAST_SHARE = 3, 0.002
#: Lengths in bytes of the word beginnings that count beside whole words.
PREFIXES = (4, 5, 6)
#: Readings of a disguised word that join the text.
READINGS = 3
#: Spaced strings of more runs of equal characters are read in windows of so many, too.
LONGEST = 32
THRESHOLD = 0.3

# Signs and the letters that they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}

_SIGN = re.escape("".join(LEET))
#: A place where a word may be disguised: three or more spaced letters, a token of letters and signs, tripled letters.
_DISGUISE = re.compile(
    rf"(?<![a-z0-9])(?P<spaced>(?:[a-z0-9@$!][ .\-_*]){{2,}}[a-z0-9@$!])(?![a-z0-9])"
    rf"|(?<![a-z{_SIGN}])(?:[a-z]++[{_SIGN}]|[{_SIGN}]++[a-z])[a-z{_SIGN}]*+|([a-z])\2\2"
)
_TOKEN = re.compile(rf"[a-z{_SIGN}]")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1*")
#: Texts are told apart by a polynomial hash.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def _classes() -> np.ndarray:
    """Bytes to letters 1-26, 27 for others beyond ASCII, 0 for all else."""
    out = np.zeros(256, np.int64)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = 27
    return out


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Letter trigrams over all documents; 28 ** 3 counts whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, letter = np.zeros(28**3, np.int64), _classes()
        for batch in pieces(batches, "text", 1 << 20):
            text = "\0\0".join([*[t or "" for t in col(batch, "text").to_pylist()], ""]).encode()
            c = letter[np.frombuffer(text, np.uint8)]
            n += np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3) if len(c) > 2 else 0
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(28**3, np.int64)
    out[rows["gram"].to_numpy(int)] = rows["n"].to_numpy()
    return out


class Channel:
    """The character model and its decoder."""

    def __init__(self, trigrams: np.ndarray):
        c = trigrams.reshape(28, 28, 28).astype(float)
        uni = c.sum((0, 1)) + 1
        bi = c.sum(0)
        p1 = uni / uni.sum()
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()
        self.cache: dict[tuple[str, bool], list[str]] = {}

    def lattice(self, runs: list[str], spaced: bool) -> list[list[str]]:
        """The readings of each run of equal characters; after and within spaced ones a word may end."""
        out = []
        for run in runs:
            letters = LEET.get(run[0], run[0])
            some = [x * k for x in letters for k in ((1,) if len(run) == 1 else (1, 2))]
            if spaced:
                some += [f"{x} {x}" for x in letters if len(run) > 1]
                some += [f"{x} " for x in some]
            out.append(some)
        return out

    def decode(self, token: str, spaced: bool = False) -> list[str]:
        """The likeliest readings, best first. Long strings of spaced letters are read as a whole, and in windows that
        overlap by half, each with readings of its own."""
        runs = [m[0] for m in _RUN.finditer(token)]
        if len(runs) <= LONGEST:
            if (token, spaced) not in self.cache:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[token, spaced] = self._decode(runs, spaced)
            return self.cache[token, spaced]
        half = LONGEST // 2
        parts = (runs[i : i + LONGEST] for i in range(0, len(runs) - half, half)) if spaced else ()
        return self._decode(runs, spaced) + [x for part in parts for x in self.decode("".join(part), spaced)]

    def _decode(self, runs: list[str], spaced: bool) -> list[str]:
        """What a reading costs from a place on depends on its last two letters alone: each state keeps its READINGS best
        texts, so no text that could be among the best ones at the end is lost. Texts are chains of their pieces, told
        apart by a hash, so a string of any length takes time in proportion."""
        cost = self.cost
        states = {(0, 0): [(0.0, 0, None)]}
        for options in self.lattice(runs, spaced):
            grown: dict[tuple[int, int], list[tuple]] = {}
            for (a, b), best in states.items():
                for o in options:
                    x, y, more, code, shift = a, b, 0.0, 0, 1
                    for ch in o:
                        k = 0 if ch == " " else ord(ch) - 96
                        more, x, y = more + cost[x][y][k], y, k
                        code, shift = (code * _BASE + k + 1) % _PRIME, shift * _BASE % _PRIME
                    grown.setdefault((x, y), []).extend([(t + more, (h * shift + code) % _PRIME, (chain, o)) for t, h, chain in best])
            states = {at: self._best(some) for at, some in grown.items()}
        ends = self._best([(t + cost[x][y][0], h, chain) for (x, y), some in states.items() for t, h, chain in some])
        out = []
        for _, _, chain in ends:
            text: list[str] = []
            while chain is not None:
                chain, o = chain
                text.append(o)
            out.append("".join(reversed(text)))
        return out

    @staticmethod
    def _best(some: list[tuple]) -> list[tuple]:
        """The READINGS likeliest of different texts."""
        if len(some) == 1:
            return some
        kept: dict[int, tuple] = {}
        for one in sorted(some, key=itemgetter(0, 1)):
            if one[1] not in kept:
                kept[one[1]] = one
                if len(kept) == READINGS:
                    break
        return list(kept.values())

    def restore(self, text: str) -> str:
        """Lower-cased text, followed by the readings of its disguised words."""
        low = text.lower()
        more, last = [], -1
        for m in _DISGUISE.finditer(low):
            s, e = m.span()
            if s < last:
                continue
            spaced = m["spaced"] is not None
            if spaced:
                tokens = [re.sub(r"[ .\-_*]", "", m[0])]
            else:
                while s > max(last, 0) and _TOKEN.match(low[s - 1]):
                    s -= 1
                while e < len(low) and _TOKEN.match(low[e]):
                    e += 1
                # A mark at the end may be a sign or not.
                bare = low[s:e].rstrip("!|+(")
                tokens = [low[s:e]] + [bare] * (bare != low[s:e])
            last = e
            for token in tokens:
                letters = sum("a" <= ch <= "z" for ch in token)
                if len(token) >= 3 and letters and (spaced or letters < len(token) or _TRIPLE.search(token)):
                    more += self.decode(token, spaced)
        return f"{low} {' '.join(more)}" if more else low


def features(texts: list[str | None], channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings of the restored texts, and the row of each."""
    raw = [channel.restore(t or "").encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    body = np.frombuffer(b"".join(raw), np.uint8)
    s, e, first = word_spans(body, at, alnum_bytes())
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    hashes, rows = [span_hash(body, s, e)], [row]
    for n in PREFIXES:
        some = np.flatnonzero(e - s > n)
        hashes.append(span_hash(body, s[some], s[some] + n) ^ np.uint64(n))
        rows.append(row[some])
    return np.concatenate(hashes), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


class Scorer:
    """Precision of each telling feature, and the calibration of a text's best one."""

    def __init__(self, hashes: np.ndarray, pos: np.ndarray, neg: np.ndarray):
        n = pos + neg
        z = 1.96
        p = pos / np.maximum(n, 1)
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        keep = np.flatnonzero(low >= 0.35)
        order = keep[np.argsort(hashes[keep])]
        self.hashes, self.value = hashes[order], low[order]
        self.steps, self.levels = np.array([0.0]), np.array([0.0])

    def raw(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The best value among each row's features, 0 without any."""
        best = np.zeros(n)
        if not len(self.hashes):
            return best
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[k] == h
        np.maximum.at(best, row[hit], self.value[k[hit]])
        return best

    def calibrate(self, raw: np.ndarray, label: np.ndarray) -> None:
        """Rates of label 1 by steps of the raw score, made to rise (pool adjacent violators)."""
        if not len(raw):
            return
        steps = np.unique(np.concatenate([[0.0], np.quantile(raw, np.linspace(0, 1, 41)), np.linspace(0.3, 1, 15)]))
        at = np.searchsorted(steps, raw, "right") - 1
        pools: list[list[float]] = []
        for k in range(len(steps)):
            mine = at == k
            pools.append([float(label[mine].sum()) + 0.1 * float(label.mean() if len(label) else 0), float(mine.sum()) + 0.1, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                a = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], a)]
        self.steps = steps
        self.levels = np.concatenate([[p / n] * int(k) for p, n, k in pools])

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated, and rising with the raw score within a step."""
        level = self.levels[np.searchsorted(self.steps, raw, "right") - 1]
        return np.clip(level * 0.98 + raw * 0.02, 0.0, 1.0)


def fold(doc_id) -> object:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Channel, Scorer]:
    """From docs(doc_id, text), all of them for the character model, and the labels of folds 0, 1 and 3."""
    spark = docs.sparkSession
    channel = Channel(count_trigrams(docs))
    given = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 2)
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = given.count()
    if n > sample_rows:
        given = given.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # The sample's ids are bounded by sample_rows, so they may be broadcast: no text is shuffled.
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(given), "doc_id"))
    n_pos = sample.filter("toxic = 1").count()
    shared = spark.sparkContext.broadcast(channel)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            h, _ = _distinct(*features(col(batch, "text").to_pylist(), shared.value))
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    # Of a document's features only so many can be in a share of all documents: the list is bounded.
    found = sample.filter("toxic = 1").select("text").mapInArrow(words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") >= max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_pos))).toPandas()
    hashes = np.sort(found["h"].to_numpy(np.int64).view(np.uint64))
    pos = np.zeros(len(hashes))
    pos[np.searchsorted(hashes, found["h"].to_numpy(np.int64).view(np.uint64))] = found["n"].to_numpy()
    known = spark.sparkContext.broadcast(hashes)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = known.value
        n = np.zeros(len(listed), np.int64)
        for batch in pieces(batches, "text", 1 << 20):
            h, _ = _distinct(*features(col(batch, "text").to_pylist(), shared.value))
            if len(listed):
                k = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
                n += np.bincount(k[listed[k] == h], minlength=len(listed))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], ["k", "n"])

    less = sample.filter("toxic <> 1").select("text").mapInArrow(others, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    neg = np.zeros(len(hashes))
    neg[less["k"].to_numpy(int)] = less["n"].to_numpy()
    scorer = Scorer(hashes, pos, neg)
    rated = _rate(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), channel, scorer).select("doc_id", "raw").toPandas()
    scorer.calibrate(rated["raw"].to_numpy(), (rated["doc_id"] == 1).to_numpy())
    return channel, scorer


def _rate(docs: DataFrame, channel: Channel, scorer: Scorer) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    channel.cache.clear()
    shared = sc.broadcast((channel, scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s = shared.value
        for batch in pieces(batches, "text", 1 << 20):
            h, row = features(col(batch, "text").to_pylist(), c)
            raw = s.raw(h, row, batch.num_rows)
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id").cast(pa.int64()), pa.array(raw), pa.array(s.score(raw))], ["doc_id", "raw", "score"])

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, "doc_id long, raw double, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text)."""
    rated = _rate(docs, *fit(docs, labels))
    return rated.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
