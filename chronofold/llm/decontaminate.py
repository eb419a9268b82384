"""Benchmark decontamination with an FM-index per training shard.

Each shard (a bounded run of a partition's documents) is turned into word ids over the
benchmark's vocabulary. Runs of in-vocabulary words at least as long as the shortest window are
indexed: suffix array, BWT, wavelet tree. All windows are searched backward at once through
wavelet-tree ranks, occurrences are located by walking to sampled suffix positions, and the hit
words are merged into removal spans.

Null and empty texts have no words and no hits; an empty benchmark hits nothing; items without
words are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_bytes, ascii_lower, byte_rows, col, cut, fresh, pieces, span_hash, word_spans

WINDOW = 13
SAMPLE = 8
#: Bytes of benchmark text in one broadcast block; larger benchmarks take more passes over the documents.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 16 << 20
HITS = "doc_id long, row long, n_words long, n_bytes long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


class WaveletTree:
    """Ranks over a sequence of ids below 2 ** bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i, elementwise."""
        lo = np.zeros_like(i)
        for level in range(self.bits):
            ones, one = self.ones[level], (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[lo], ones[i]
            lo = np.where(one, self.zeros[level] + a, lo - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - lo


class FMIndex:
    """Over ids; id 0 separates runs and is never part of a pattern. The sequence begins and ends with 0."""

    def __init__(self, ids: np.ndarray, n_symbols: int):
        n = len(ids)
        # Separators rank below all words and differ from each other, so no comparison crosses a run.
        zeros = ids == 0
        rank = np.where(zeros, np.cumsum(zeros) - 1, ids + int(zeros.sum())).astype(np.int64)
        step = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1
            order = np.lexsort((nxt, rank))
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (nxt[order[1:]] != nxt[order[:-1]]))
            rank = new
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.sa = order
        self.bwt = ids[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(n_symbols).bit_length()))
        counts = np.bincount(ids, minlength=n_symbols + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        # Sampled positions, and all run starts, end a walk.
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of patterns of one length (rows)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.sa), np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by LF steps to a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            out[live[done]] = self.sa[rows[live[done]]] + steps[live[done]]
            live = live[~done]
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
        return out


class _Patterns:
    """All distinct windows of a benchmark block as ids, by length, with the items they come from."""

    def __init__(self, items: list[tuple[str, str]]):
        ok = alnum_bytes()
        bodies = [np.frombuffer((t or "").encode(), np.uint8) for _, t in items]
        at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        body = ascii_lower(np.concatenate(bodies)) if bodies else np.zeros(0, np.uint8)
        s, e, first = word_spans(body, at, ok)
        h = span_hash(body, s, e)
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h) + 1
        owners: dict[tuple, set] = defaultdict(set)
        for k, (item, _) in enumerate(items):
            words = ids[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                owners[tuple(words[i : i + WINDOW])].add(str(item))
        self.by_length: dict[int, tuple[np.ndarray, list[set]]] = {}
        for n in sorted({len(w) for w in owners}):
            some = [w for w in owners if len(w) == n]
            self.by_length[n] = (np.array(some, np.int64), [owners[w] for w in some])
        self.shortest = min(self.by_length, default=WINDOW)

    def find(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """(starts, lengths) of occurrences in word positions, and the items by row. first: row offsets."""
        none = np.zeros(0, np.int64)
        if not len(ids) or not self.by_length:
            return none, none, {}
        inside = ids > 0
        edge = np.ones(len(ids) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[first] = True
        cuts = np.flatnonzero(edge)
        a, b = cuts[:-1], cuts[1:]
        keep = inside[a] & (b - a >= self.shortest)
        a, b = a[keep], b[keep]
        if not len(a):
            return none, none, {}
        size = b - a + 1
        start = np.concatenate([[1], 1 + np.cumsum(size)])
        text = np.zeros(int(start[-1]), np.int64)
        where = np.zeros(int(start[-1]), np.int64)
        index = np.repeat(a - start[:-1], b - a) + (spread := np.concatenate([np.arange(x, y) for x, y in zip(start[:-1], start[:-1] + b - a)]))
        text[spread], where[spread] = ids[index], index
        fm = FMIndex(text, len(self.vocab))
        starts, lengths, items = [], [], defaultdict(set)
        for n, (patterns, owners) in self.by_length.items():
            lo, hi = fm.search(patterns)
            count = hi - lo
            if not count.sum():
                continue
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
            pos = where[fm.locate(rows)]
            starts.append(pos)
            lengths.append(np.full(len(pos), n))
            row = np.searchsorted(first, pos, "right") - 1
            for r, w in set(zip(row.tolist(), which.tolist())):
                items[r] |= owners[w]
        return (np.concatenate(starts) if starts else none, np.concatenate(lengths) if starts else none, items)


def _scan(docs: DataFrame, patterns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok, p = alnum_bytes(), patterns.value
        for batch in pieces(batches, "text", SHARD_BYTES):
            raw, at = byte_rows(col(batch, "text"))
            body = ascii_lower(raw)
            s, e, first = word_spans(body, at, ok)
            h = span_hash(body, s, e)
            ids = np.zeros(len(h), np.int64)
            if len(p.vocab) and len(h):
                k = np.minimum(np.searchsorted(p.vocab, h), len(p.vocab) - 1)
                ids = np.where(p.vocab[k] == h, k + 1, 0)
            starts, lengths, items = p.find(ids, first)
            delta = np.zeros(len(h) + 1, np.int64)
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + lengths, -1)
            hit = np.cumsum(delta[:-1]) > 0
            edge = np.zeros(len(h) + 1, bool)
            edge[1:-1] = hit[1:] != hit[:-1]
            edge[[0, -1]] = True
            edge[first] = True
            cuts = np.flatnonzero(edge) if len(h) else np.zeros(1, np.int64)
            a, b = cuts[:-1], cuts[1:]
            a, b = a[hit[a]] if len(a) else a, b[hit[a]] if len(a) else b
            spans: dict[int, list] = defaultdict(list)
            for x, y, r in zip(a.tolist(), b.tolist(), (np.searchsorted(first, a, "right") - 1).tolist()):
                spans[r].append({"first": x - int(first[r]), "last": y - 1 - int(first[r]), "start": int(s[x] - at[r]), "end": int(e[y - 1] - at[r])})
            n = batch.num_rows
            span_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays(
                [
                    col(batch, "doc_id").cast(pa.int64()),
                    col(batch, "row").cast(pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([spans.get(r, []) for r in range(n)], span_type),
                    pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string())),
                ],
                ["doc_id", "row", "n_words", "n_bytes", "spans", "items"],
            )

    return docs.mapInArrow(run, HITS)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (item_id, text) in blocks of bounded size; its size is checked first."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): word count, merged hit spans (words and bytes) and the items found.
    A benchmark beyond one block is searched block by block and the spans are merged by document."""
    sc = docs.sparkSession.sparkContext
    keyed = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("row"), docs["text"])
    found = [_scan(keyed, sc.broadcast(_Patterns(items))) for items in blocks(benchmark)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Equal rows of one document give equal spans, so they may share a group; `copies` restores them.
    merged = every.groupBy("doc_id", "row", "n_words", "n_bytes").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(found)).cast("int").alias("copies"),
    )
    return merged.withColumn("spans", merge_spans("spans")).withColumn("c", F.explode(F.sequence(F.lit(1), "copies"))).drop("c", "copies")


def merge_spans(name: str):
    """Union of word spans that touch or overlap, in order."""
    return F.expr(
        f"""aggregate(array_sort({name}),
              cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>),
              (acc, x) -> case when size(acc) > 0 and x.first <= element_at(acc, -1).last + 1
                then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first,
                  'last', greatest(element_at(acc, -1).last, x.last), 'start', element_at(acc, -1).start,
                  'end', greatest(element_at(acc, -1).end, x.end))))
                else concat(acc, array(x)) end)"""
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    hits = find(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents (5 % of words hit or more); hit spans of the others are cut out."""
    hits = find(docs, benchmark).filter(F.size("spans") > 0)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    own = {c: fresh(docs, f"hit_{c}") for c in ("doc_id", "row", "n_words", "spans", "n_hit", "key")}
    hits = hits.withColumn("n_hit", n_hit).select(*[F.col(c).alias(own[c]) for c in ("doc_id", "row", "n_words", "spans", "n_hit")])
    # Written first: few rows as a rule, and a join of known size then needs no shuffle of the texts.
    hits = cut(hits.dropDuplicates([own["doc_id"], own["row"]]))
    keyed = docs.withColumn(own["key"], F.xxhash64("text"))
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col(own["doc_id"])) & (F.col(own["key"]) == F.col(own["row"])), "left")
    kept = joined.filter(F.col(own["n_hit"]).isNull() | (20 * F.col(own["n_hit"]) < F.col(own["n_words"])))
    cut_out = F.expr(
        f"decode(aggregate({own['spans']}, named_struct('at', 0L, 'out', cast('' as binary)), "
        "(acc, x) -> named_struct('at', x.end, 'out', concat(acc.out, substring(cast(text as binary), int(acc.at + 1), int(x.start - acc.at)))), "
        "acc -> concat(acc.out, substring(cast(text as binary), int(acc.at + 1)))), 'UTF-8')"
    )
    text = F.when(F.col(own["n_hit"]).isNull(), F.col("text")).otherwise(cut_out)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
