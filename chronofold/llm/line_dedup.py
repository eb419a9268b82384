"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

1. Equal lines are collapsed first: one row for each distinct text, with the place of its first occurrence.
2. A line's shingles are the 5 characters from every place on (the whole line, where it is shorter). Its
   signature is SIDE * SIDE minima of the shingle hashes, each under another constant (exclusive or); the
   places of the signature form a square whose rows and columns are the bands. Minima are taken over the
   quarter of the shingles that their own hash picks, and the line's first one; lines under SHORT
   characters have a second signature, over all their shingles, to meet each other. Over all shingles,
   lines at similarity 0.8 share a band with probability 0.95, at 0.85 with 0.987, at 0.9 with 0.998.
3. In each band every line meets the band's first line, then a few others that it is not linked with yet.
   Distributed union-find joins what links; at last all pairs of a band that are still in different
   components meet, in the first band that they share, if a parity sketch, which never calls two sets further
   apart than they are, allows the threshold. Nothing is capped.
4. Pairs whose signatures agree in AGREE places at least (at similarity 0.8 all but 0.2 %) are verified by
   Jaccard on whole shingle sets (as 64-bit hashes), and union-find keeps the first line (by doc_id, then line) of each
   component.

Lines are compared trimmed and lower-cased; blank lines always stay and null texts stay null. Rows
without doc_id stay whole and take part in nothing; of equal rows the same lines go. A line is one row
whatever its length; no lines (an empty table, blank texts) give no rows. Ties of place, as in rows that
share a doc_id, leave each of the tied lines.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, uncut
from .graph import components

PERCENT = 80
#: Characters of a shingle.
GRAM = 5
#: Hashes of a band; the signature has SIDE * SIDE. With more lines than some 10^8, six keep chance pairs few.
SIDE = 5
#: Lines of fewer characters have a signature over all their shingles too.
SHORT = 128
#: Equal places of two signatures from which a pair is verified.
AGREE = 14
#: Longs of a parity sketch.
PARITY = 16
#: Further leaders that each line of a longer band meets before the pairs across components do.
ROUNDS = 2
#: A line that has more than 1 / HOT of all occurrences is joined by broadcast; there are fewer than HOT.
HOT = 1000
#: doc_id * SHIFT + line number orders lines; decimal, so no id is too large.
SHIFT = 1 << 31
#: White space that may surround a line, all but the line feed.
WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

_PLACES = range(SIDE * SIDE)
_MASKS = [random.Random(j).getrandbits(64) - (1 << 63) for j in _PLACES]
#: Signature places of each band: rows and columns.
_BANDS = [
    *[[SIDE * i + k for k in range(SIDE)] for i in range(SIDE)],
    *[[SIDE * k + i for k in range(SIDE)] for i in range(SIDE)],
]
#: Signature places in one long, a byte each; the eighth byte stays free for sums.
_PACK = 7
_LOW = 0x7F7F7F7F7F7F7F
_SKETCH = [f"s{i}" for i in range(0, SIDE * SIDE, _PACK)]


def shingles(line: Column) -> Column:
    """The distinct shingles of a line; one at least. Pairs are verified on their `hashes`, which are made several times faster."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))
    return F.when(F.length(line) >= GRAM, F.array_distinct(found)).otherwise(F.array(line))


def grams(lines: DataFrame) -> DataFrame:
    """lines(id, norm) to (id, at, h): the place and hash of each shingle, repeats included."""
    units = lines.select("id", F.expr("encode(norm, 'UTF-32')").alias("u"), F.length("norm").alias("n"))
    places = units.select("id", "u", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - GRAM, F.lit(0)))).alias("at"))
    return places.select("id", "at", F.xxhash64(F.expr(f"substring(u, 4 * at + 1, {4 * GRAM})")).alias("h"))


def hashes(line: Column) -> Column:
    """The hash of the shingle at each place of a line, repeats included. The text is a variable of the outer function, so
    it is encoded once, not for each place."""
    width, step = F.lit(4 * GRAM), F.lit(4)
    at = lambda u: F.sequence(F.lit(0), F.greatest((F.octet_length(u) / step).cast("int") - GRAM, F.lit(0)))
    each = lambda u: F.transform(at(u), lambda i: F.xxhash64(F.substring(u, step * i + 1, width)))
    return F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), each))


def _minima(shingles: DataFrame, kind: int) -> DataFrame:
    low = shingles.groupBy("id").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{j}") for j, m in enumerate(_MASKS)])
    return low.withColumn("kind", F.lit(kind))


def signatures(lines: DataFrame) -> DataFrame:
    """lines(id, norm) to (id, kind, bands, sketch columns): band hashes, and a byte of each minimum."""
    some = _minima(grams(lines).filter((F.col("h").bitwiseAND(F.lit(3)) == 0) | (F.col("at") == 0)), 0)
    low = some.unionByName(_minima(grams(lines.filter(F.length("norm") < SHORT)), 1))
    bands = F.array(*[F.xxhash64(F.lit(k), "kind", *[f"m{j}" for j in band]) for k, band in enumerate(_BANDS)])
    packed = []
    for i in range(0, SIDE * SIDE, _PACK):
        some = [F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit(255)), 8 * (j - i)) for j in _PLACES[i : i + _PACK]]
        whole = some[0]
        for x in some[1:]:
            whole = whole.bitwiseOR(x)
        packed.append(whole.alias(f"s{i}"))
    return low.select("id", "kind", bands.alias("bands"), *packed)


def agreement(a: str, b: str) -> Column:
    """In how many places the sketches with the prefixes a and b agree."""
    n = F.lit(-(_PACK * len(_SKETCH) - SIDE * SIDE))
    for s in _SKETCH:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        used = (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseOR(F.lit(_LOW)).bitwiseAND(F.lit((1 << 56) - 1))
        n = n + F.lit(56) - F.bit_count(used)
    return n


def parities(lines: DataFrame) -> DataFrame:
    """lines(id, norm) to (id, n, parity columns): the number of distinct shingles, and for each of 64 * PARITY
    buckets whether an odd number of them is in it."""
    distinct = lines.select("id", F.explode(F.array_distinct(hashes(F.col("norm")))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(PARITY - 1))
    return distinct.groupBy("id").agg(F.count("*").alias("n"), *[F.bit_xor(F.when(word == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{j}") for j in range(PARITY)])


def near(a: str, b: str, percent: int) -> Column:
    """Whether parities allow two lines to meet the threshold: their distance is the sets' difference at most."""
    apart = sum((F.bit_count(F.col(f"{a}p{j}").bitwiseXOR(F.col(f"{b}p{j}"))) for j in range(PARITY)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(a + "n") + F.col(b + "n"))


def first_shared(a: str, b: str) -> Column:
    """Whether a band is the first one that two lines share: true in one of their bands, however many they share."""
    return F.element_at(F.array_intersect(f"{a}bands", f"{b}bands"), 1) == F.col(f"{a}band")


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at, ord, id, more, norm) of every line that is not blank; id and more are 128 bits of its hash."""
    lines = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"], F.posexplode(F.transform(F.split(F.lower(docs["text"]), "\n"), lambda x: F.trim(x, F.lit(WHITE)))).alias("at", "norm"))
    lines = lines.filter("norm <> ''")  # trimmed within the array: once, not for the filter and again for each column
    order = F.col("doc_id").cast("decimal(20,0)") * F.lit(SHIFT).cast("decimal(10,0)") + F.col("at").cast("decimal(10,0)")
    return lines.select("doc_id", "at", order.cast("decimal(38,0)").alias("ord"), F.xxhash64("norm").alias("id"), F.xxhash64(F.lit("more"), "norm").alias("more"), "norm")


def _side(df: DataFrame, prefix: str, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in cols])


def links(texts: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, root) of the lines texts(id, norm, first) that are linked with others, by `first`; None without any.
    texts is a cut, and deleted as soon as only lines that share a band are needed."""
    sketches = cut(signatures(texts.select("id", "norm")))
    keyed = sketches.select("id", "kind", F.explode("bands").alias("band"))
    # One shuffle finds the bands of several lines and their seats; a band's rows may spill.
    here = Window.partitionBy("band")
    crowded = keyed.select("*", F.min("id").over(here).alias("lead"), F.max("id").over(here).alias("last"), F.count("*").over(here).alias("c"))
    seats = cut(crowded.filter("lead <> last").drop("last"))
    at = ["id", "kind"]
    # From here on only lines that share a band.
    some = seats.select("id").distinct()
    # Sketches first, so that the whole ones are gone while texts are shuffled.
    sketches = cut(sketches.join(some, "id", "left_semi"), sketches)
    near_texts = cut(texts.select("id", "first", "norm").join(some, "id", "left_semi"), texts)
    edges: DataFrame | None = None
    root: DataFrame | None = None

    def merge(pairs: DataFrame) -> None:
        """Add the links of the pairs (a, b) of ids, whose sketches agree, that meet the threshold."""
        nonlocal edges, root
        pairs = cut(pairs.select("a", "b").distinct())
        # Texts meet, not sets: a set is many times its text, and would be shuffled and sorted with each pair.
        x, y = (near_texts.select(F.col("id").alias(i), F.col("first").alias(n), F.col("norm").alias(n + "t")) for i, n in (("a", "x"), ("b", "y")))
        both = pairs.join(x, "a").join(y, "b").select("x", "y", F.array_distinct(hashes(F.col("xt"))).alias("xs"), F.array_distinct(hashes(F.col("yt"))).alias("ys"))
        same = F.size(F.array_intersect("xs", "ys"))
        # Written with its verdict, so that no set is made once for the filter and again for a column.
        verdicts = cut(both.select(F.col("x").alias("a"), F.col("y").alias("b"), ((100 + percent) * same >= percent * (F.size("xs") + F.size("ys"))).alias("ok")), pairs)
        new = verdicts.filter("ok").select("a", "b")
        if not new.take(1):
            uncut(verdicts)
            return
        edges = new if edges is None else edges.unionByName(new)
        if root is not None:
            uncut(root)
        root = components(edges)

    def seated(seats: DataFrame) -> DataFrame:
        """The seats with their lines' components."""
        roots = near_texts.select("id", "first")
        if root is None:
            return seats.join(roots.withColumnRenamed("first", "root"), "id")
        roots = roots.join(root.withColumnRenamed("node", "first"), "first", "left")
        return seats.join(roots.select("id", F.coalesce("root", "first").alias("root")), "id")

    def led(pairs: DataFrame) -> None:
        """Verify the pairs (id, lead, kind)."""
        pairs = pairs.select("id", "kind", "lead").distinct()
        pairs = pairs.join(_side(sketches, "x", *at, *_SKETCH).withColumnsRenamed({"xid": "id", "xkind": "kind"}), at)
        pairs = pairs.join(_side(sketches, "y", *at, *_SKETCH).withColumnsRenamed({"yid": "lead", "ykind": "kind"}), ["lead", "kind"])
        merge(pairs.filter(agreement("x", "y") >= AGREE).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")))

    led(seats.filter("id <> lead"))
    # Bands of two lines are done. In the others each line meets a few more leaders, where it is not linked yet.
    seats = cut(seats.filter("c > 2").select("band", *at), seats)
    for r in range(ROUNDS):
        here = cut(seated(seats))
        turn = F.xxhash64("id", F.lit(r))
        lead = here.groupBy("band").agg(F.min_by("id", turn).alias("lead"), F.min_by("root", turn).alias("lead_root"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        led(here.join(lead, "band").filter("root <> lead_root"))
        uncut(here)

    # What is left: pairs of a band across components. One of the two is outside the band's largest component.
    here = cut(seated(seats), seats)
    shares = here.groupBy("band", "root").agg(F.count("*").alias("c"))
    open_bands = shares.groupBy("band").agg(F.max("c").alias("c"), F.count("*").alias("roots")).filter("roots > 1").select("band", "c")
    major = shares.join(open_bands, ["band", "c"]).groupBy("band").agg(F.min("root").alias("major"))
    here = cut(here.join(major, "band").join(sketches.drop("bands"), at), here)
    known = ["band", "id", "root", "major", *_SKETCH]
    x, y = _side(here, "x", *known), _side(here, "y", *known)
    apart = (F.col("xband") == F.col("yband")) & (F.col("xroot") != F.col("yroot")) & (agreement("x", "y") >= AGREE)
    # Only lines with a candidate need a parity sketch.
    some = x.join(y, apart, "left_semi").select(F.col("xid").alias("id")).distinct()
    facts = cut(parities(near_texts.join(some, "id").select("id", "norm")))
    seats = cut(here.join(facts, "id").join(sketches.select(*at, "bands"), at), here)
    uncut(facts)
    known += ["n", *[f"p{j}" for j in range(PARITY)], "bands"]
    x, y = _side(seats.filter("root <> major"), "x", *known), _side(seats, "y", *known)
    once = (F.col("xid") < F.col("yid")) | (F.col("yroot") == F.col("ymajor"))
    # Near lines share several bands, and meet in the first of them alone: if that is a band of two, they have met.
    rest = x.join(y, apart & once & near("x", "y", percent) & first_shared("x", "y"))
    merge(rest.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")))
    for used in (seats, sketches, near_texts):
        uncut(used)
    return root


def repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, at) of every line to drop."""
    lines = explode_lines(docs)
    texts = cut(lines.groupBy("norm").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.min("id").alias("id"), F.min("more").alias("more")))
    firsts = cut(texts.drop("norm"))
    most = (firsts.agg(F.sum("n")).first()[0] or 0) // HOT
    root = links(texts, percent)
    if root is not None:
        firsts = firsts.join(root.select(F.col("node").alias("first"), "root"), "first", "left").withColumn("best", F.coalesce("root", "first"))
    else:
        firsts = firsts.withColumn("best", F.col("first"))
    # Lines that occur once and lead their component need no second look.
    loose = cut(firsts.filter("n > 1 or first <> best").select("id", "more", "n", "best"))
    keys = lines.select("doc_id", "at", "ord", "id", "more")
    # At most HOT lines are more than a HOT-th of all lines each. They take the other join with a key of their own place,
    # which spreads them and matches nothing: documents are read and cut once for both joins.
    hot = F.broadcast(loose.filter(F.col("n") > most).select("id", "more", F.col("best").alias("hot")))
    keys = keys.join(hot, ["id", "more"], "left")
    keys = keys.withColumn("key", F.when(F.col("hot").isNull(), F.col("id")).otherwise(F.xxhash64("doc_id", "at"))).drop("id")
    cold = loose.filter(F.col("n") <= most).select(F.col("id").alias("key"), "more", "best", F.lit(True).alias("cold"))
    out = keys.withColumn("cold", F.col("hot").isNull()).join(cold, ["key", "more", "cold"], "left").withColumn("best", F.coalesce("hot", "best"))
    return out.filter("ord <> best").select("doc_id", "at")


def _parted(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, Column, Column]:
    """docs(doc_id, text, ...) with one more column; what it says: positions of the lines that go (null for
    none), and the text without them."""
    key, gone = fresh(docs, "doc"), fresh(docs, "gone")
    lost = repeats(docs, percent).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("at").alias(gone))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return docs.join(lost, F.col("doc_id") == F.col(key), "left").drop(key), F.col(gone), F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)


def report(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines dropped, and the digest of what stays."""
    parted, gone, kept = _parted(docs.select(docs["doc_id"], docs["text"]))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")
    out = parted.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.coalesce(kept, F.lit("")).alias("kept"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("kept").cast("long").alias("kept_bytes"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines cut out; documents that had lines and keep none go."""
    parted, gone, kept = _parted(docs)
    left = fresh(parted, "kept")
    out = parted.withColumn(left, kept).filter(gone.isNull() | (F.trim(F.col(left), F.lit(WHITE)) != ""))
    new = {"text": F.col(left), "n_chars": F.length(left).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
