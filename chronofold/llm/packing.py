"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become token ids (a byte-level BPE and the end id 0). Longer ones than a sequence are
cut; what is left of each document is one piece of 1 to CAPACITY tokens. Pieces of one size are
interchangeable, so packing works on the histogram of sizes (CAPACITY numbers, whatever the input):
bins with equal contents are one class with a count. Best fit by decreasing size fills the classes;
local search then moves pieces, exchanges one for one and two for one between underfull classes
whenever the sum of squared fills grows, until bins empty or nothing grows. Finally each document
finds its place by its rank within its size: classes lay out ranges of ranks.

Null and empty texts are the end id alone; equal rows are packed separately; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut

CAPACITY = 2048
#: Rounds of the local search over all underfull classes.
ROUNDS = 4
#: Classes that a class is compared with at most in one round, best candidates first.
PARTNERS = 64

Bin = tuple[int, ...]  # sizes in falling order


# ---------------------------------------------------------------- the plan, on the histogram


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Classes of equal bins, by best fit with falling sizes. Whole groups of bins are filled at once."""
    classes: Counter = Counter()
    open_by_room: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(contents: Bin, room: int, n: int) -> None:
        if not open_by_room[room] and room:
            insort(rooms, room)
        open_by_room[room][contents] += n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put((size,) * each, capacity - each * size, full)
                if rest:
                    put((size,) * rest, capacity - rest * size, 1)
                left = 0
                continue
            room = rooms[at]
            contents, n = next(iter(open_by_room[room].items()))
            each = room // size
            take = min(n, left // each)
            if take:
                added = each
            else:
                take, added = 1, left
            open_by_room[room][contents] -= take
            if not open_by_room[room][contents]:
                del open_by_room[room][contents]
            if not open_by_room[room]:
                rooms.remove(room)
            put(contents + (size,) * added, room - added * size, take)
            left -= take * added
    for room in open_by_room.values():
        classes.update(room)
    return classes


def _without(b: Bin, *sizes: int) -> list[int]:
    out = list(b)
    for s in sizes:
        out.remove(s)
    return out


def _bin(sizes: list[int]) -> Bin:
    return tuple(sorted(sizes, reverse=True))


def _best_step(a: Bin, b: Bin, capacity: int) -> tuple[int, Bin, Bin] | None:
    """The move or exchange between two bins that most increases the sum of squared fills."""
    fa, fb = sum(a), sum(b)
    room, best = capacity - fb, (0, a, b)

    def offer(shift: int, make) -> None:
        """shift: tokens that go from a to b."""
        nonlocal best
        if shift > room or fa - shift > capacity:
            return
        gain = (fa - shift) ** 2 + (fb + shift) ** 2 - fa**2 - fb**2
        if gain > best[0]:
            best = (gain, *make())

    sa, sb = sorted(set(a)), sorted(set(b))
    for x in sa:  # moves, a to b
        offer(x, lambda x=x: (_bin(_without(a, x)), _bin([*b, x])))
    for x in sa:  # one for one
        for y in sb:
            if x > y:
                offer(x - y, lambda x=x, y=y: (_bin([*_without(a, x), y]), _bin([*_without(b, y), x])))
    pairs = sorted({(x, z) for i, x in enumerate(a) for z in a[i + 1 :]})
    for x, z in pairs:  # two of a for one of b
        for y in sb:
            if x + z > y:
                offer(x + z - y, lambda x=x, y=y, z=z: (_bin([*_without(a, x, z), y]), _bin([*_without(b, y), x, z])))
    pairs = sorted({(y, z) for i, y in enumerate(b) for z in b[i + 1 :]})
    for y, z in pairs:  # one of a for two of b
        for x in sa:
            if x > y + z:
                offer(x - y - z, lambda x=x, y=y, z=z: (_bin([*_without(a, x), y, z]), _bin([*_without(b, y, z), x])))
    return best if best[0] else None


def local_search(classes: Counter, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Counter:
    """Steps between underfull classes, from the emptiest on, done for as many bins at once as both have."""
    classes = Counter(classes)
    for _ in range(rounds):
        grew = False
        queue = [(sum(b), b) for b in classes if sum(b) < capacity]
        heapq.heapify(queue)
        fullest = sorted(queue, reverse=True)
        seen = 0
        while queue and seen < 4 * CAPACITY:
            fill, a = heapq.heappop(queue)
            seen += 1
            if not classes[a]:
                continue
            found = None
            for other, b in fullest[:PARTNERS]:
                if b == a or not classes[b] or other < fill:
                    continue
                step = _best_step(a, b, capacity)
                if step and (found is None or step[0] > found[0][0]):
                    found = (step, b)
            if not found:
                continue
            (_, na, nb), b = found
            n = min(classes[a], classes[b])
            for old in (a, b):
                classes[old] -= n
                if not classes[old]:
                    del classes[old]
            for new in (na, nb):
                if new:
                    classes[new] += n
                    if sum(new) < capacity:
                        heapq.heappush(queue, (sum(new), new))
                        insort(fullest, (sum(new), new), key=lambda t: (-t[0],))
            if classes[a]:
                heapq.heappush(queue, (fill, a))
            grew = True
        if not grew:
            break
    return classes


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    return local_search(best_fit(histogram, capacity), capacity)


class Layout:
    """Where the r-th piece of each size goes."""

    def __init__(self, classes: Counter):
        by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # (pieces, first sequence, offset)
        at = 0
        for contents in sorted(classes):
            offset = 0
            for size in contents:
                by_size[size].append((classes[contents], at, offset))
                offset += size
            at += classes[contents]
        self.sequences = at
        self.ranges = {}
        for size, parts in by_size.items():
            n, first, offset = (np.array(x, np.int64) for x in zip(*parts))
            self.ranges[size] = (np.cumsum(n), np.cumsum(n) - n, first, offset)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for s in np.unique(size):
            of = np.flatnonzero(size == s)
            ends, starts, first, offsets = self.ranges[int(s)]
            k = np.searchsorted(ends, rank[of], "right")
            sequence[of] = first[k] + rank[of] - starts[k]
            offset[of] = offsets[k]
        return sequence, offset


# ---------------------------------------------------------------- on DataFrames


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder:
    """Ids of the tokenizer file. Its twin as byte ranks, where there is one beside it, gives the same ids faster;
    texts that spell a special token go to the tokenizer itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [x.content for x in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        twin = path.removesuffix(".json") + ".tiktoken"
        try:
            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        except FileNotFoundError:
            return
        import public_tokenizers
        import tiktoken

        self.fast = tiktoken.Encoding("byte ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, _Encoder] = {}


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, part, within, first, n_full, crcs[, ids]): `first` tokens in the first
    piece (1 to capacity), then n_full pieces of `capacity`, with each piece's crc32. within: how many
    documents of the same task, `part`, had as many tokens in their first piece before."""
    path = tokenizer or default_tokenizer()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "part", "within", "first", "n_full", "crcs"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), Counter()
        enc = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.array(enc.ids(text.as_py() or "") + [0], "<u4")
                    n_full = (len(ids) - 1) // capacity
                    first = len(ids) - n_full * capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                    rows.append((doc, task, met[first], first, n_full, crcs, *[ids.astype(np.int32)] * with_ids))
                    met[first] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, part int, within long, first int, n_full int, crcs array<long>" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].
    Pieces of a whole sequence have negative sequence ids, packed ones 0 and up."""
    spark = docs.sparkSession
    # Tokenised once and written, so that ranks stay as they are when a task is repeated.
    made = cut(pieces_of(docs, tokenizer, capacity, with_ids))
    counts = made.groupBy("part", "first").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("first").orderBy("part")) - F.col("n")
    offsets = counts.select("part", "first", before.alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("first").agg(F.sum("n")).collect()}
    layout = spark.sparkContext.broadcast(Layout(plan(histogram, capacity)))

    # Rank within (task, size) plus the rows of the size in earlier tasks.
    ranked = made.join(offsets, ["part", "first"])
    keep = ["doc_id", "first", "n_full", "crcs"] + ["ids"] * with_ids
    ranked = ranked.select(*keep, (F.col("within") + F.col("before")).alias("rank"))
    schema = StructType([*ranked.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("first")).to_numpy().astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = layout.value.place(size, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, schema)
    rows = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    whole = F.col("piece") > 0
    start = F.when(whole, F.col("first") + (F.col("piece") - 1) * F.lit(capacity)).otherwise(0).cast("long")
    length = F.when(whole, F.lit(capacity)).otherwise(F.col("first")).cast("long")
    # Unique for (size, rank, piece): 11 + 1 bits of size, 20 of piece, the rest of rank.
    own = -1 - ((F.col("rank") * 4096 + F.col("first")) * (1 << 20) + F.col("piece"))
    out = [
        F.col("doc_id"),
        F.col("piece").cast("int").alias("piece"),
        start.alias("start"),
        length.alias("length"),
        F.col("ids_crc32"),
        F.when(whole, own).otherwise(F.col("sequence_id")).cast("long").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    ]
    if with_ids:
        out.append(F.slice("ids", (start + 1).cast("int"), length.cast("int")).alias("ids"))
    return rows.select(*out)
