"""Hard-negative mining by norm-bucketed search over integer vectors.

Candidates are sorted by their norm and cut into buckets, largest norms first. A score is an inner product,
so no row of a bucket scores more with an anchor than the anchor's norm times the bucket's largest norm
(Cauchy-Schwarz). An anchor looks into a bucket only while that bound reaches what it still needs: the lower
limit of one of its windows, or, once a window is full, the score of its running k-th row.

Two searches of one form: first each anchor's POSITIVES best rows of its own label (a window without
limits), then for each positive the NEGATIVES best rows of other labels whose score is within the window
that the positive's score sets. Each search goes in two rounds. The first looks into the buckets of the largest
norms alone and leaves every anchor a running k-th score; the second takes anchors, sorted by the norm they still
need, to the buckets that can matter. Anchors and candidates travel in packed blocks of bounded size; blocks of
one anchor block are dealt in slices over tasks, and a task hands on only the best rows of each window.

The query set grows with the rows (those with an id divisible by 50), and vectors of one norm leave nothing to
prune, so in the worst case the work is all blocks of anchors by all buckets: in blocks, never row by row.

Null ids, labels, vectors, and vectors with a null or non-finite component take no part; nor do vectors whose
number of components is not that of most rows. Components beyond 64 bits are cut to that range. Inner products
are exact: in floating point while they stay below 2^53, else in 64-bit or unbounded integers; a score that does
not fit a long is given as the nearest long. Rows that repeat an id are rows of their own: each is another row
to the others, and a repeated anchor gives its result once for each of them. Ties go to the smaller id. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cut, uncut

POSITIVES, NEGATIVES = 5, 3
#: Rows of a packed block of candidates, and of anchors.
BUCKET, ANCHORS = 2048, 1024
#: Buckets of the first round, and of a slice of the second.
FIRST, SLICE = 4, 16
_NO_LIMIT = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """embeddings(vec_id, embedding, label) to (vec_id, label, q): labels of every shift_every-th id moved on by one,
    components floor(scale * x)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(sound, F.lit(False)))
    label = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    big = float(2**63)
    q = F.transform("x", lambda x: F.when(x * scale >= big, F.lit(_NO_LIMIT)).when(x * scale < -big, F.lit(-_NO_LIMIT)).otherwise(F.floor(x * scale)))
    return v.select("vec_id", label.alias("label"), q.cast("array<long>").alias("q"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = top(a) * top(b) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    # Compared and returned as longs, the nearest ones.
    return np.clip(a.astype(object) @ b.astype(object).T, -_NO_LIMIT, _NO_LIMIT).astype(np.int64)


def _packed(rows: DataFrame, size: int, kind: str, extra: str = "") -> DataFrame:
    """Rows in their order as blocks of at most `size`: (kind, norm, need, n, ids, labels, q, extra columns)."""
    names = ["row", "vec_id", "label", *extra.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                n = part.num_rows
                q = col(part, "q").flatten().to_numpy(zero_copy_only=False)
                lists = {c: col(part, c).flatten() if pa.types.is_list(col(part, c).type) else col(part, c) for c in names}
                blobs = [pa.array([x.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]) for x in [*lists.values()]]
                top = col(part, "norm").to_numpy().max()
                need = col(part, "need").to_numpy().min() if "need" in part.schema.names else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([float(need)]), pa.array([n], pa.int32()), *blobs, pa.array([q.astype(np.int64).tobytes()])], ["norm", "need", "n", *names, "q"])

    schema = "norm double, need double, n int, " + ", ".join(f"{c} binary" for c in names) + ", q binary"
    return rows.mapInArrow(run, schema).withColumn("kind", F.lit(kind))


def _numbered(packed: DataFrame, name: str, *by) -> DataFrame:
    """Packed blocks, written, with their number in the order of `by`: a rank over one small row for each block."""
    made = cut(packed.withColumn("at", F.monotonically_increasing_id()))
    numbers = made.select("at", (F.row_number().over(Window.orderBy(*by, "at")) - 1).alias(name))
    return cut(made.join(numbers, "at").drop("at"), made)


def _longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


class _Anchors:
    """One block of anchors and the best rows found for each of their windows so far."""

    def __init__(self, block: dict, windows: int, k: int, same: bool):
        n = block["n"]
        self.row, self.label, self.ids = _longs(block["row"]), _longs(block["label"]), _longs(block["vec_id"])
        self.q = _longs(block["q"]).reshape(n, -1)
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        shape = (n, windows)
        self.lo, self.hi, self.floor = (_longs(block[c]).reshape(shape) for c in ("lo", "hi", "floor"))
        self.k, self.same = k, same
        self.score = np.full((*shape, k), -_NO_LIMIT - 1)
        self.id = np.full((*shape, k), _NO_LIMIT)

    def look(self, block: dict) -> None:
        """A bucket's rows, for the anchors and windows to which they can matter."""
        kth = np.maximum(np.maximum(self.lo, self.floor), self.score[:, :, -1])
        # A bound equal to the k-th score still matters: ties go to the smaller id.
        live = np.flatnonzero(((self.norm * block["norm"])[:, None] >= kth).any(1) & (self.lo <= self.hi).any(1))
        if not len(live):
            return
        ids, label, row = _longs(block["vec_id"]), _longs(block["label"]), _longs(block["row"])
        q = _longs(block["q"]).reshape(block["n"], -1)
        scores = _product(self.q[live], q)
        fit = (self.label[live][:, None] == label) == self.same
        fit &= self.row[live][:, None] != row
        for w in range(self.lo.shape[1]):
            ok = fit & (scores >= kth[live, w][:, None]) & (scores <= self.hi[live, w][:, None])
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            s, d = scores[i, j], ids[j]
            # Old and new rows of each window together, the k best of each.
            have = np.nonzero(self.score[live, w] >= -_NO_LIMIT)
            i, s, d = np.concatenate([i, have[0]]), np.concatenate([s, self.score[live, w][have]]), np.concatenate([d, self.id[live, w][have]])
            order = np.lexsort((d, -s, i))
            i, s, d = i[order], s[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < self.k
            self.score[live[i[keep]], w, rank[keep]] = s[keep]
            self.id[live[i[keep]], w, rank[keep]] = d[keep]

    def found(self) -> pa.RecordBatch:
        a, w, r = np.nonzero(self.score >= -_NO_LIMIT)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.row[a], w.astype(np.int32), self.score[a, w, r], self.id[a, w, r])], ["row", "window", "score", "id"])


def _search(anchors: DataFrame, buckets: DataFrame, windows: int, k: int, same: bool, slices: Column) -> DataFrame:
    """(row, window, score, id): the k best rows of each window, of each slice of buckets. anchors are blocks
    numbered `block`; buckets come with the block that they are for, and their slice."""
    sides = anchors.withColumn("order", F.lit(-1.0)).withColumn("slice", F.explode(slices))
    both = sides.unionByName(buckets.withColumn("order", F.lit(1.0)), allowMissingColumns=True)
    n = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    both = both.repartition(n, "block", "slice").sortWithinPartitions("block", "slice", "order", F.desc("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            for k_ in range(batch.num_rows):
                block = {c: v[0].as_py() for c, v in zip(batch.schema.names, batch.slice(k_, 1).columns)}
                if (block["block"], block["slice"]) != at and now is not None:
                    yield now.found()
                    now = None
                at = block["block"], block["slice"]
                if block["kind"] == "anchors":
                    now = _Anchors(block, windows, k, same)
                elif now is not None:
                    now.look(block)
        if now is not None:
            yield now.found()

    return both.drop("order").mapInArrow(run, "row long, window int, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window over all slices, ranked from 1."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(anchors: DataFrame, buckets: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """(row, window, rank, score, id): for each anchor's windows the k best rows with the anchor's label (same) or
    another one. anchors(row, vec_id, label, q, norm, lo, hi), the limits as arrays of `windows` longs; buckets as
    packed and numbered by falling norm."""
    need = lambda a: F.array_min(F.transform(F.arrays_zip("lo", "floor", "hi"), lambda x: F.when(x["lo"] <= x["hi"], F.greatest(x["lo"], x["floor"])).otherwise(_NO_LIMIT))) / (a * (1 + 1e-9))
    columns = ["row", "vec_id", "label", "q", "norm", "lo", "hi", "floor"]

    def blocks(rows: DataFrame) -> DataFrame:
        # Sorted by the norm they still need, so that a block's anchors look into the same buckets.
        rows = rows.withColumn("need", F.coalesce(need(F.greatest(F.col("norm"), F.lit(1e-9))), F.lit(0.0)))
        return _numbered(_packed(rows.sort("need"), ANCHORS, "anchors", "lo hi floor"), "block", "need")

    first = blocks(anchors.withColumn("floor", F.array_repeat(F.lit(-_NO_LIMIT), windows)).select(*columns))
    n = first.count()
    some = buckets.filter(F.col("number") < FIRST).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"))).withColumn("slice", F.lit(0))
    seen = cut(_best(_search(first, some.drop("number"), windows, k, same, F.array(F.lit(0))), k))
    kth = seen.filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    again = anchors.join(kth, "row", "left").withColumn("floor", F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda w: F.coalesce(F.col("kth")[w], F.lit(-_NO_LIMIT))))
    second = blocks(again.select(*columns))
    rest = buckets.filter(F.col("number") >= FIRST)
    last = (buckets.agg(F.max("number")).first()[0] or 0) // SLICE
    # Blocks are numbered by rising need, so a bucket matters to those before a number: a running count over one small
    # row for each block and bucket.
    both = second.select(F.col("need").alias("at"), F.lit(None).cast("int").alias("number")).union(rest.select(F.col("norm").alias("at"), "number"))
    upto = both.withColumn("upto", F.sum(F.when(F.col("number").isNull(), 1).otherwise(0)).over(Window.orderBy("at", F.col("number").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rest.join(upto.filter("number is not null and upto > 0").select("number", "upto"), "number")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("upto").cast("int") - 1))).withColumn("slice", F.col("number") % (last + 1)).drop("number", "upto")
    found = cut(_search(second, dealt, windows, k, same, F.sequence(F.lit(0), F.lit(last))).unionByName(seen.drop("rank")))
    for x in (first, second, seen):
        uncut(x)
    return _best(found, k)


def mine(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 50, most: int = 95) -> DataFrame:
    """vectors(vec_id, label, q) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor (id divisible by `every`) and each of its best positives the best negatives whose score is within least to
    most percent of the positive's."""
    wide = vectors.select(F.size("q").alias("d")).groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    vectors = vectors.filter(F.size("q") == (wide[0] if wide else 0))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * (1 + 1e-9)
    rows = cut(vectors.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()))
    buckets = _numbered(_packed(rows.sort(F.desc("norm"), "vec_id"), BUCKET, "bucket"), "number", F.desc("norm"))

    anchors = rows.filter(F.col("vec_id") % every == 0)
    open_ = anchors.withColumn("lo", F.array(F.lit(-_NO_LIMIT))).withColumn("hi", F.array(F.lit(_NO_LIMIT)))
    best = cut(search(open_, buckets, 1, positives, True))
    # The window of each positive, in integers: least * p <= 100 * s <= most * p.
    lo, hi = (-F.expr(f"floor(-score * {least}bd / 100)")).cast("long"), F.expr(f"floor(score * {most}bd / 100)").cast("long")
    limits = best.withColumn("lo", lo).withColumn("hi", hi).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))
    pad = lambda c, x: F.slice(F.concat(F.col(f"w.{c}"), F.array_repeat(F.lit(x), positives)), 1, positives)
    inner = anchors.join(limits, "row").withColumn("lo", pad("lo", _NO_LIMIT)).withColumn("hi", pad("hi", -_NO_LIMIT)).drop("w")
    hard = search(inner, buckets, positives, negatives, False)
    p = best.select("row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(p, ["row", "window"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
