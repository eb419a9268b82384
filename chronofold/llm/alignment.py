"""Alignment of two tokenizers by elementary intervals.

Both tokenizers read the same bytes, space + text: A is a byte-level BPE, B a piece model that adds the
space itself. The union of both arrays of token ends cuts the bytes into elementary intervals; searchsorted
finds the token of A and of B that own each one, so an interval is one overlap of two tokens, a link. Ends
that both have close groups; the pairs of a group's tokens are its product, of which the links are the
overlapping part.

A text is cut before each space that follows a non-space. No token of either kind reaches over such a place
(A's pattern takes a space at a token's start only; B's vocabulary is checked for it), so it is a shared
end, and each stretch has its tokens, links and groups whatever stands around it. Stretches repeat, so a
worker keeps what it knows of at most KNOWN of them; others are aligned many at a time. A text of which a
stretch does not come back as its own bytes is encoded whole, as are all texts if a tokenizer has no such
places.

How many documents hold an id pair is counted with partial aggregation over each document's distinct pairs.
Pairs that are frequent, at most FREQUENT whatever the input (those in at least 1/FREQUENT of all documents'
pairs), go to the tasks as a list of that proven size; documents' other pairs are joined with their counts.

Null and empty texts, and texts whose tokens of A or B are not their bytes, have no tokens: zeros, and '' as
groups_sha256. Equal rows count as documents each; rows without a doc_id are documents too. Very long texts
are aligned whole. Pairs that are equally frequent for a token of A are all its best. An empty table gives no
rows; other columns of the documents are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, pieces

#: Stretches that a worker remembers.
KNOWN = 400_000
#: Bound on the pairs whose counts every task gets.
FREQUENT = 1 << 17
_CUT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"\s ")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and the stretches met so far."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = _byte_letters()
        size = self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.n_b = len(self.b_bytes)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.code = np.int32 if size * self.n_b < 1 << 31 else np.int64
        # Ids in decimal with what follows them: the next id of the side, or the side's end.
        self.text = [[np.array([f"{i}{end}" for i in range(n)], object) for end in ends] for n, ends in ((size, ",|"), (self.n_b, ",;"))]
        self.fast = None
        try:
            with open(a.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
        except FileNotFoundError:
            ranks = None
        if ranks:
            import public_tokenizers
            import tiktoken

            # The same vocabulary as byte ranks: the same ids, sooner.
            self.fast = tiktoken.Encoding("byte ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Cutting at spaces is exact: A splits by the known pattern, no piece of B goes on after a space within.
        self.cuts = self.fast is not None and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.n_b))
        self.known: dict[str, tuple[str, bytes, int] | bool] = {}

    def encode(self, keys: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for space + key; B adds the space itself."""
        if self.fast:
            a = [self.fast.encode_ordinary(" " + k) for k in keys]
        else:
            a = [e.ids for e in self.a.encode_batch([" " + k for k in keys], add_special_tokens=False)]
        return a, self.b.encode(list(keys), num_threads=1)

    def align(self, keys: Sequence[str]) -> list[tuple[str, bytes, int] | bool]:
        """For each space + key: its groups as text, the codes of its links, and its tokens (A << 32 | B); False where
        tokens are not its bytes."""
        a, b = self.encode(keys)
        raw = [b" " + k.encode() for k in keys]
        sides = []
        for ids, size, names in ((a, self.a_size, self.a_bytes), (b, self.b_size, self.b_bytes)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
            sides.append((n, flat, np.concatenate([[0], np.cumsum(size[flat])]), names))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        right = np.ones(len(raw), bool)
        for n, _, ends, _ in sides:
            right &= np.diff(ends[np.concatenate([[0], np.cumsum(n)])]) == lengths
        whole = b"".join(raw)
        if right.all() and all(b"".join(map(names.__getitem__, flat.tolist())) == whole for _, flat, _, names in sides):
            return list(self._aligned(*[x[:2] for x in sides]))
        one = [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for r, x, y in zip(raw, a, b)]
        done = iter(self.align([k for k, ok in zip(keys, one) if ok]) if any(one) else ())
        return [next(done) if ok else False for ok in one]

    def _aligned(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[str, bytes, int]]:
        """a, b: tokens of each unit, and all their ids."""
        (n_a, a_ids), (n_b, b_ids) = a, b
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        ends = np.union1d(a_ends, b_ends)
        a_own, b_own = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        codes = (a_ids[a_own] * self.n_b + b_ids[b_own]).astype(self.code).tobytes()
        shared = ends[(a_ends[a_own] == ends) & (b_ends[b_own] == ends)]
        # Decimal ids, group by group, A's side first.
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        at = np.arange(len(shared))
        a_upto, b_upto = np.searchsorted(a_group, at, "right"), np.searchsorted(b_group, at, "right")
        b_before = np.concatenate([[0], b_upto[:-1]])
        out = np.empty(len(a_ids) + len(b_ids), object)
        for ids, group, shift, (more, last) in ((a_ids, a_group, b_before, self.text[0]), (b_ids, b_group, a_upto, self.text[1])):
            final = np.concatenate([group[1:] != group[:-1], [True]])
            out[np.arange(len(ids)) + shift[group]] = np.where(final, last[ids], more[ids])
        out = out.tolist()
        tokens = np.cumsum(n_a + n_b).tolist()
        links = (np.searchsorted(ends, a_ends[np.cumsum(n_a) - 1], "right") * np.dtype(self.code).itemsize).tolist()
        i = j = 0
        for upto, link, n in zip(tokens, links, (n_a << 32 | n_b).tolist()):
            yield "".join(out[i:upto])[:-1], codes[j:link], n
            i, j = upto, link

    def documents(self, texts: Sequence[str | None]) -> Iterator[tuple[str, bytes, int] | None]:
        """The alignment of each text; None without tokens."""
        if not self.cuts:
            yield from ((self.align([t])[0] or None) if t else None for t in texts)
            return
        # Stretches without their first space. Where no white space stands before a space, they are the words between.
        cuts = [(t.split(" ") if not _RUN.search(t) and t[0] != " " else [s[1:] for s in _CUT.split(" " + t)]) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        found = [list(map(self.known.get, x)) for x in cuts]
        new = list({s for x, f in zip(cuts, found) if None in f for s, e in zip(x, f) if e is None})
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            self.known.update(zip(part, self.align(part)))
        for t, x, f in zip(texts, cuts, found):
            got = [self.known[s] if e is None else e for s, e in zip(x, f)] if None in f else f
            if not got:
                yield None
            elif False in got:
                yield self.align([t])[0] or None
            else:
                yield ";".join([g[0] for g in got]), b"".join([g[1] for g in got]), sum([g[2] for g in got])


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(a: str, b: str) -> Pair:
    return _pairs.get((a, b)) or _pairs.setdefault((a, b), Pair(a, b))


def products(groups: str) -> list[tuple[int, int]]:
    """All (A id, B id) of each group, of groups as `a1,a2|b1;a3|b2`: the groups' products, links and more."""
    sides = ([list(map(int, s.split(","))) for s in g.split("|")] for g in groups.split(";") if g)
    return [(x, y) for a, b in sides for x in a for y in b]


def _links(docs: DataFrame, a: str, b: str, with_groups: bool) -> DataFrame:
    """One row per document: counts, digest, distinct link codes and how often each occurs."""
    code = pa.int32() if _pair(a, b).code is np.int32 else pa.int64()
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(code), pa.list_(pa.int32())] + [pa.string()] * with_groups
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(a, b)
        for batch in pieces(batches, "text", 1 << 21):
            rows = []
            for doc, found in zip(col(batch, "doc_id").to_pylist(), both.documents(col(batch, "text").to_pylist())):
                if found is None:
                    rows.append((doc, 0, 0, 0, 0, "", [], [], *[""] * with_groups))
                    continue
                groups, codes, n = found
                pairs, times = np.unique(np.frombuffer(codes, both.code), return_counts=True)
                rows.append((doc, n >> 32, n & 0xFFFFFFFF, groups.count(";") + 1, len(codes) // np.dtype(both.code).itemsize, hashlib.sha256(groups.encode()).hexdigest(), pairs, times.astype(np.int32), *[groups] * with_groups))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    whole = "int" if code == pa.int32() else "long"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{whole}>, times array<int>" + ", groups string" * with_groups
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold each id pair, and whether no pair of its A id is held by more."""
    counts = cut(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("pair", F.col("pair").cast("long")))
    top = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("top"))
    both = counts.withColumn("a", F.expr(f"pair div {n_b}")).join(top, "a")
    return cut(both.select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), counts)


def align(docs: DataFrame, a: str | None = None, b: str | None = None, with_groups: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups])."""
    a, b = a or default_tokenizers()[0], b or default_tokenizers()[1]
    links = cut(_links(docs, a, b, with_groups).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(links, _pair(a, b).n_b)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = -(-total // frequent)  # at most `frequent` pairs can be in so many documents
    listed = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast([listed.column(c).to_numpy() for c in ("pair", "n", "best")])
    code = dict(links.dtypes)["pairs"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists, times = col(batch, "pairs"), col(batch, "times")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            own, often = lists.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[k] == own if len(pair) else np.zeros(len(own), bool)
            sums = []
            for x in (best, n):
                upto = np.zeros(len(own) + 1, np.int64)
                if len(pair):
                    np.cumsum(np.where(hit, x[k] * often, 0), out=upto[1:])
                sums.append(pa.array(np.diff(upto[at])))
            rest = np.concatenate([[0], np.cumsum(~hit)])[at].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit], t)) for x, t in ((own, lists.type.value_type), (often, pa.int32()))]
            yield pa.RecordBatch.from_arrays([col(batch, "row"), *sums, *left], ["row", "best", "total", "pairs", "times"])

    parts = cut(links.select("row", "pairs", "times").mapInArrow(summed, f"row long, best long, total long, pairs {code}, times array<int>"))
    rare = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").cast("long").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("rare_best"), F.sum(F.col("n") * F.col("times")).alias("rare_total"))
    out = links.drop("pairs", "times").join(parts.select("row", "best", "total"), "row").join(rare, "row", "left")
    n_best, count_sum = F.col("best") + F.coalesce("rare_best", F.lit(0)), F.col("total") + F.coalesce("rare_total", F.lit(0))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256", *["groups"] * with_groups)
