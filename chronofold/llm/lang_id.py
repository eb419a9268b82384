"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree up to ORDER bytes deep, built from a training sample and
then frozen. A byte's code length follows PPM method C: in a context with n symbols seen t times,
an escape costs log2((t + n) / n) bits and a seen symbol log2((t + n) / count); an unseen symbol
falls to the next shorter context, below order 0 to a uniform byte. A text's score in a language is
its exact code length, summed over all bytes of the whole text.

As the statistics are frozen, each (context, byte) has a fixed cost in every language: costs of all
full-depth contexts seen in training are tabulated together, and scoring is array look-ups.

Null texts and texts without a letter are `und` with score 0; ties go to the first language by name;
an empty table gives no rows; without training rows every text is `und`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, col, pieces

ORDER = 3
#: The classifier is fitted on a bounded sample: about this many labelled documents of each language ...
SAMPLE_DOCS = 2000
#: ... of which texts above this many bytes are not drawn.
SAMPLE_BYTES = 65536
#: A text that no language codes below this many bits a byte is not language at all; the pipeline rejects it.
REJECT_BITS = 6.5


class Model:
    """Frozen PPM statistics of all languages."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: per language, the (ORDER + 1)-byte strings seen, as big-endian integers, and their counts."""
        self.langs = langs
        n = len(langs)
        self.base = np.full((256, n), 8.0, np.float32)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        lower_cost = self.base.astype(np.float64)
        for order in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            keys = np.unique(np.concatenate([grams[x][0] & mask for x in langs])) if langs else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            cost = np.zeros((len(keys), n))
            escape = np.zeros((len(contexts), n))
            shorter = self._lower(keys, order, lower_cost)
            for j, x in enumerate(langs):
                ids = np.searchsorted(keys, grams[x][0] & mask)
                count = np.bincount(ids, grams[x][1], len(keys))
                ctx = np.searchsorted(contexts, keys >> np.uint64(8))
                total = np.bincount(ctx, count, len(contexts))
                kinds = np.bincount(ctx, count > 0, len(contexts))
                known = total > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[known, j] = np.log2((total[known] + kinds[known]) / kinds[known])
                    seen = np.log2((total[ctx] + kinds[ctx]) / count)
                cost[:, j] = np.where(count > 0, seen, escape[ctx, j] + shorter[:, j])
            self.levels.append((keys, cost, contexts, escape))
            lower_cost = cost
        self._freeze()

    def _lower(self, keys: np.ndarray, order: int, lower_cost: np.ndarray) -> np.ndarray:
        """Cost of each key's last byte in the next shorter context."""
        if order == 0:
            return lower_cost[keys.astype(np.int64)]
        return self.cost_at(keys & np.uint64((1 << (8 * order)) - 1), order - 1)

    def cost_at(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Exact costs of (order + 1)-byte strings' last bytes, seen or not."""
        level, contexts, escape = self.levels[order][:2], self.levels[order][2], self.levels[order][3]
        known, cost = level
        out = np.empty((len(keys), len(self.langs)))
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        out[hit] = cost[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            shorter = self.base[(keys[miss] & np.uint64(255)).astype(np.int64)] if order == 0 else self.cost_at(keys[miss] & np.uint64((1 << (8 * order)) - 1), order - 1)
            ctx = keys[miss] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, ctx), max(len(contexts) - 1, 0))
            there = contexts[at] == ctx if len(contexts) else np.zeros(len(miss), bool)
            out[miss] = shorter + np.where(there[:, None], escape[at] if len(contexts) else 0.0, 0.0)
        return out

    def _freeze(self) -> None:
        """A hash table of the full-depth strings: slot to key, and costs in 4-byte floats."""
        keys, cost = self.levels[ORDER][:2]
        bits = max(16, int(len(keys) * 4).bit_length())
        self.shift = np.uint32(32 - bits)
        slot = self._slot(keys.astype(np.uint32))
        order = np.argsort(slot, kind="stable")[::-1]  # of keys in one slot the first stays; the others are looked up the long way
        self.slot_key = np.zeros(1 << bits, np.uint32)
        self.slot_at = np.full(1 << bits, -1, np.int32)
        self.slot_key[slot[order]] = keys[order].astype(np.uint32)
        self.slot_at[slot[order]] = order
        self.cost = np.ascontiguousarray(cost.astype(np.float32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> self.shift

    def bits(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of every row in every language."""
        n_rows, out = len(at) - 1, np.zeros((len(at) - 1, len(self.langs)))
        size = np.diff(at)
        # Every row is coded after ORDER zero bytes, as in training.
        padded = np.zeros(len(body) + ORDER * n_rows, np.uint8)
        starts = at[:-1] + ORDER * np.arange(n_rows)
        inside = np.ones(len(padded), bool)
        inside[(starts[:, None] + np.arange(ORDER)).ravel()] = False
        padded[inside] = body
        if not len(body):
            return out
        p = padded.astype(np.uint32)
        keys = (p[:-3] << np.uint32(24)) | (p[1:-2] << np.uint32(16)) | (p[2:-1] << np.uint32(8)) | p[3:]
        keys = keys[inside[ORDER:]]
        slot = self._slot(keys)
        where = self.slot_at[slot]
        miss = np.flatnonzero((self.slot_key[slot] != keys) | (where < 0))
        cost = self.cost[where]
        if len(miss):
            distinct, back = np.unique(keys[miss], return_inverse=True)
            cost[miss] = self.cost_at(distinct.astype(np.uint64), ORDER)[back]
        full = np.flatnonzero(size)
        for j in range(len(self.langs)):
            out[full, j] = np.add.reduceat(cost[:, j].astype(np.float64), at[:-1][full])
        return out


def _gram_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            langs = np.array(col(batch, "lang").to_pylist())
            body, at = byte_rows(col(batch, "text"))
            for lang in np.unique(langs):
                parts = [np.concatenate([np.zeros(ORDER, np.uint8), body[at[k] : at[k + 1]]]) for k in np.flatnonzero(langs == lang)]
                keys = []
                for p in parts:
                    p = p.astype(np.int64)
                    keys.append((p[:-3] << 24) | (p[1:-2] << 16) | (p[2:-1] << 8) | p[3:])
                grams, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from labelled(doc_id, text, lang). Rows without language or text teach nothing.
    The sample is drawn by hash, evenly by language, and is bounded by sample_docs and SAMPLE_BYTES."""
    rows = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null and octet_length(text) between 1 and %d" % SAMPLE_BYTES)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], {})
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / counts[k])))])
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)).alias("chance")
    drawn = rows.withColumn("chance", chance).filter(F.col("chance") < share[F.col("lang")])
    found = _gram_counts(drawn.select("lang", "text")).toPandas()
    grams = {}
    for lang in langs:
        own = found[found["lang"] == lang].sort_values("gram")
        grams[lang] = (own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy().astype(np.float64))
    return Model(langs, grams)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to (doc_id, lang_pred, score, n_bytes, bits): the cheapest language, its
    probability at equal priors with code lengths capped to 256 bytes' worth, and its code length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, "text", 1 << 20):
            text = col(batch, "text")
            body, at = byte_rows(text)
            n, size = batch.num_rows, np.diff(at)
            spoken = has_letter(text, body, at)
            if m.langs:
                bits = m.bits(body, at)
                best = bits.argmin(1)
                rate = bits / np.maximum(size, 1)[:, None] * np.minimum(size, 256)[:, None]
                with np.errstate(under="ignore"):
                    weight = np.exp2(rate.min(1)[:, None] - rate)
                score = 1 / weight.sum(1)
                spent = bits[np.arange(n), best]
            else:
                spoken = np.zeros(n, bool)
                best, score, spent = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            lang = [m.langs[b] if s else "und" for b, s in zip(best.tolist(), spoken.tolist())]
            yield pa.RecordBatch.from_arrays(
                [col(batch, "doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(np.where(spoken, score, 0.0)), pa.array(size, pa.int64()), pa.array(spent)],
                ["doc_id", "lang_pred", "score", "n_bytes", "bits"],
            )

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double, n_bytes long, bits double")


def has_letter(text: pa.Array, body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with a letter: an ASCII one by bytes, else any by Unicode."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    sums = np.concatenate([[0], np.cumsum(letter[body])])
    out = sums[at[1:]] > sums[at[:-1]]
    for k in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[k] = any(c.isalpha() for c in text[int(k)].as_py() or "")
    return out


def fold(doc_id) -> object:
    """crc32 of the id as text, mod 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """Languages of docs(doc_id, text, lang), learned from the rows of folds 0 and 2."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def keep_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without rows whose text is no language: null, without a letter, or coded at REJECT_BITS or more."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 1))
    shared = spark.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, "text", 1 << 20):
            text = col(batch, "text")
            body, at = byte_rows(text)
            ok = has_letter(text, body, at)
            if m.langs:
                ok &= m.bits(body, at).min(1) < REJECT_BITS * np.maximum(np.diff(at), 1)
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, schema)
