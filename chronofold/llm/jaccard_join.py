"""N-gram Jaccard self-join by grouped prefixes, up to connected components.

A document's set is its distinct word shingles. Sets are ordered rare-first by a fixed-size frequency
sketch, so two sets that meet the threshold share a token of their prefixes. Equal sets are one class;
classes with the same prefix and size are one group, which posts its prefix tokens once. Groups that
share a token and have fitting sizes are candidate pairs; pairs are expanded to members and verified
exactly on whole sets.

A shared token counts only where its places in both rare-first orders leave room for the overlap that the
two sizes need. In each of a few rounds every list pairs its groups with one leader of fitting size
(another one each round), unless both are already connected; what is left are group pairs across
components, which are all looked at. So no connection is lost, and near copies below the threshold, whose
own rare tokens come first, do not meet. A group of several classes is never counted as connected, and
its classes meet in a list of their own. A parity sketch of at least one bit an element, whose distance
never exceeds the sets' difference, discards pairs before whole sets meet.

Null, empty and blank texts have empty sets and stay alone. Equal rows share their set; rows of one
doc_id with different texts are connected through that id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, byte_rows, col, cut, mix, nonspace_bytes, pieces, span_hash, uncut, word_spans
from .graph import components

BUCKETS = 1 << 19
#: Least size of a sketch in longs.
SKETCH = 8
ROUNDS = 3


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    raw, at = byte_rows(col(batch, "text"))
    s, e, first = word_spans(ascii_lower(raw), at, nonspace_bytes())
    h = span_hash(ascii_lower(raw), s, e)
    rolled = h.copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            if len(h) > j:
                rolled[:-j] = mix(rolled[:-j] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
        for i in range(batch.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = h[a : a + 1]
                for j in range(a + 1, b):
                    short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
                yield mix(short + np.uint64(b - a))
            else:
                yield h[:0]


def _digest(s: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets have a token in each bucket, over all documents; BUCKETS numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, "text"):
            sets = [np.zeros(0, np.uint64), *_sets(batch, k)]
            n += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def _meta(docs: DataFrame, k: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """Per row: set size, set digest (two longs), prefix digest, prefix and parity sketch. Sketches have
    SKETCH longs times a power of two, so that halves fold onto each other; `small` is folded to SKETCH longs."""
    ranks = docs.sparkSession.sparkContext.broadcast(frequency)
    names = ["doc_id", "n", "d1", "d2", "g", "prefix", "sketch", "small"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = ranks.value
        for batch in pieces(batches, "text"):
            rows = []
            for s in _sets(batch, k):
                n = len(s)
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                order = np.lexsort((s, freq[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:keep]
                prefix = s[order]
                d = _digest(s)
                g = np.frombuffer(hashlib.blake2b(prefix.tobytes(), digest_size=8).digest(), np.int64)
                bits = 64 * SKETCH << max(0, (n - 1).bit_length() - (64 * SKETCH).bit_length() + 1)
                odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
                rows.append((n, d[0], d[1], g[0], prefix.view(np.int64), sketch, np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH))))
            c = list(zip(*rows))
            longs = pa.list_(pa.int64())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), longs, longs, longs]
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id").cast(pa.int64()), *map(pa.array, c, kinds)], names)

    schema = "doc_id long, n int, d1 long, d2 long, g long, prefix array<long>, sketch array<long>, small array<long>"
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, schema)


def _whole_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of texts(doc_id, d1, d2, text) whose set has the digest asked for, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            asked = zip(col(batch, "d1").to_pylist(), col(batch, "d2").to_pylist())
            sets = list(_sets(batch, k))
            same = [tuple(_digest(s)) == d for s, d in zip(sets, asked)]
            node = col(batch, "doc_id").filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([node, pa.array([s.view(np.int64) for s, ok in zip(sets, same) if ok], pa.list_(pa.int64()))], ["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])


def _fits(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def cluster(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_shingles, component_id), one row per row: documents link when
    100 * |intersection| >= percent * |union|."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    meta = cut(_meta(docs, k, percent, _frequencies(docs, k)))
    full = meta.filter("n > 0")

    # Classes of equal sets, named by their smallest document; groups of classes by prefix and size.
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min("g").alias("g"), F.min("n").alias("n")))
    groups = cut(classes.groupBy("g", "n").agg(F.min("node").alias("leader"), F.count("*").alias("members")))
    heads = full.select(F.col("doc_id").alias("leader"), "g", "n", "prefix").join(groups, ["leader", "g", "n"]).dropDuplicates(["leader", "g", "n"])
    post = heads.select(F.posexplode("prefix").alias("at", "token"), F.col("leader").alias("node"), "n", (F.col("members") > 1).alias("many"))
    # How many tokens a set has from the shared one on.
    post = post.select("token", "node", "n", (F.col("n") - F.col("at")).alias("room"), "many")
    lively = post.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token")
    members = cut(classes.join(groups.filter("members > 1").select("g", "n", "leader"), ["g", "n"]).select("leader", "node", "g", "n"))
    own = members.select(F.col("g").alias("token"), "node", "n", F.col("n").alias("room"), F.lit(False).alias("many"))
    level = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    seats = cut(post.join(lively, "token").unionByName(own).withColumn("level", level))

    def may_link(a: str, b: str):
        """Whether two seats of a list leave room for the threshold; true at the first token two linked sets share."""
        n = F.col(a + "n") + F.col(b + "n")
        return _fits(a + "n", b + "n", percent) & (F.least(a + "room", b + "room") * (100 + percent) >= n * percent)

    def expanded(pairs: DataFrame) -> DataFrame:
        """Group pairs (a, a_many, b, b_many) to the pairs of their classes."""
        for x in ("a", "b"):
            inside = members.select(F.col("leader").alias(x), F.lit(True).alias(f"{x}_many"), F.col("node").alias(f"{x}_node"))
            pairs = pairs.join(inside, [x, f"{x}_many"], "left").withColumn(x, F.coalesce(f"{x}_node", x)).drop(f"{x}_node")
        return pairs.filter("a <> b").select("a", "b")

    def near(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) whose sizes and sketches allow the threshold."""
        p = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        some = p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
        named = classes.join(some, "node", "left_semi").select(F.col("node").alias("doc_id"), "d1", "d2")
        facts = cut(full.join(named, ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch"))
        side = lambda x: facts.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"))
        p = p.join(side("a"), "a").join(side("b"), "b").filter(_fits("a_n", "b_n", percent))
        folded = lambda x, y: F.expr(f"if(size({x}) > size({y}), zip_with(slice({x}, 1, int(size({x}) / 2)), slice({x}, int(size({x}) / 2) + 1, int(size({x}) / 2)), (u, v) -> u ^ v), {x})")
        p = p.select("a", "b", "a_n", "b_n", folded("a_s", "b_s").alias("x"), folded("b_s", "a_s").alias("y"))
        p = p.withColumn("apart", F.expr("aggregate(zip_with(x, y, (u, v) -> bit_count(u ^ v)), 0, (t, u) -> t + u)"))
        # |difference| <= (1 - t) / (1 + t) * (|a| + |b|) at similarity t
        return p.filter(F.col("apart") * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)).select("a", "b", "a_n", "b_n")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that meet the threshold; only their documents' whole sets are made."""
        p = cut(near(pairs))
        wanted = cut(p.select(F.col("a").alias("node")).union(p.select("b")).distinct())
        named = classes.join(wanted, "node", "left_semi").select(F.col("node").alias("doc_id"), "d1", "d2")
        sets = cut(_whole_sets(docs.join(named, "doc_id").select("doc_id", "d1", "d2", "text"), k))
        x, y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
        both = p.join(x, "b").join(y, "a").withColumn("common", F.size(F.array_intersect("ta", "tb")))
        out = cut(both.filter((100 + percent) * F.col("common") >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b"))
        for used in (p, wanted, sets):
            uncut(used)
        return out

    edges: DataFrame | None = None
    root: DataFrame | None = None

    def merge(pairs: DataFrame) -> bool:
        """Add the pairs' links; whether there were any."""
        nonlocal edges, root
        new = linked(pairs)
        if not new.take(1):
            return False
        edges = new if edges is None else edges.unionByName(new)
        root = components(edges)
        return True

    def seated() -> DataFrame:
        if root is None:
            return seats.withColumn("root", F.col("node"))
        return seats.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def side(df: DataFrame, prefix: str, *cols: str) -> DataFrame:
        return df.select(*[F.col(c).alias(prefix + c) for c in cols])

    apart = (F.col("xnode") != F.col("ynode")) & ((F.col("xroot") != F.col("yroot")) | F.col("xmany") | F.col("ymany"))
    known = ["node", "n", "room", "root", "many"]
    for r in range(ROUNDS):
        here = cut(seated())
        turn = F.xxhash64("node", F.lit(r))
        lead = here.groupBy("token", "level").agg(*[F.min_by(c, turn).alias(f"y{c}") for c in known])
        # A list's leader also meets the next smaller level, whose sizes may fit.
        up = here.select("token", *[F.col(c).alias(f"x{c}") for c in known], F.explode(F.array("level", F.col("level") + 1)).alias("level"))
        pairs = up.join(lead, ["token", "level"]).filter(apart & may_link("x", "y"))
        merge(expanded(pairs.select(F.col("xnode").alias("a"), F.col("xmany").alias("a_many"), F.col("ynode").alias("b"), F.col("ymany").alias("b_many"))))
        uncut(here)

    # What is left: pairs across components. One side is outside its list's largest component.
    here = cut(seated())
    shares = here.groupBy("token", "root").agg(F.count("*").alias("c"), F.max("many").alias("many"))
    major = shares.groupBy("token").agg(F.max_by("root", "c").alias("major"), F.count("*").alias("roots"), F.max("many").alias("some")).filter("roots > 1 or some").select("token", "major")
    listed = cut(here.join(major, "token").withColumn("minor", F.col("many") | (F.col("root") != F.col("major"))), here)
    some = classes.join(listed.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("doc_id"), "d1", "d2")
    smalls = full.join(some, ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "small")
    # A group's sketch is its leader's, which says nothing of the other classes.
    listed = cut(listed.join(smalls, "node").withColumn("small", F.when(~F.col("many"), F.col("small"))), listed)
    known += ["small"]
    x, y = side(listed.filter("minor"), "x", "token", *known), side(listed, "y", "token", "minor", *known)
    once = ~F.col("yminor") | (F.col("xnode") < F.col("ynode"))
    distance = sum((F.bit_count(F.col("xsmall")[i].bitwiseXOR(F.col("ysmall")[i])) for i in range(SKETCH)), F.lit(0))
    close = F.coalesce(distance * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent), F.lit(True))
    rest = x.join(y, (F.col("xtoken") == F.col("ytoken")) & apart & once & may_link("x", "y") & close)
    merge(expanded(rest.select(F.col("xnode").alias("a"), F.col("xmany").alias("a_many"), F.col("ynode").alias("b"), F.col("ymany").alias("b_many"))))
    for used in (seats, listed, groups, members):
        uncut(used)

    named = classes.select("d1", "d2", F.col("node").alias("component_id"))
    if root is not None:
        named = classes.join(root, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("component_id"))
    out = meta.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; of rows with one
    doc_id one stays. Rows without doc_id all stay."""
    groups = cut(cluster(docs, k, percent))
    out = docs.join(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    if groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").take(1):
        first = out.filter("doc_id is not null").dropDuplicates(["doc_id"])
        out = first.unionByName(out.filter("doc_id is null"))
    return out.select(*docs.columns)
