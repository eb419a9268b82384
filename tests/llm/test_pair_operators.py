"""Alignment, hard negatives and substring dedup against brute force, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from chronofold.llm import alignment, hard_negatives, line_dedup, substring_dedup
from chronofold.llm.queries import QUERIES

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def passages():
    """Copies, near copies, shared passages, and rows that share a doc_id."""
    base, shared = words(80, 1), words(30, 2)
    near = base[:40] + ["changed"] + base[41:]
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(words(50, 3) + shared)), (5, " ".join(shared + words(50, 4))), (6, None), (7, ""), (8, " \n\t "), (9, "one"),
        (10, "\n".join(shared[:13])), (11, " ".join(shared[:12])), (12, " ".join(words(3000, 5, 3))), (13, " ".join(words(3000, 6, 3))), (14, "a " * 40), (15, "a " * 40),
        (16, " ".join(base[:20])), (16, " ".join(base[:20])), (16, " ".join(base[30:60])), (None, " ".join(base)), (17, "été " * 5 + " ".join(shared[5:25])), (17, "other"),
    ]


def brute_substrings(rows, window=13):
    seen, out = {}, []
    split = [(d, SPACE_WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                seen[k] = min(seen.get(k, d), d)
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_against_all_windows(spark):
    rows = passages()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, place string, marks int")
    key = lambda r: tuple(map(str, r))
    got = substring_dedup.dedup(docs, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute_substrings(rows), key=key)
    whole = next(r for r in got if r.doc_id == 2)
    assert whole.n_factors == 1 and whole.longest == 80 and whole.kept == "" and whole.spans[0].ref_doc == 1
    assert next(r for r in got if r.doc_id == 3).n_factors == 2
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_substring_dedup_of_passages_that_repeat_within_their_first_document(spark, tmp_path):
    """A boundary phrase that stands several times in its first document, or in several rows of it, whose windows also
    start in a smaller doc_id under another phrase."""
    rows = []
    for k in range(12):
        passage = words(40, 100 + k)
        start = 3 + k
        piece = passage[start : start + 13 + k % 4]
        rows.append((10 * k + 1, " ".join(passage)))
        rows.append((10 * k + 2, " ".join(["x", *piece, "y", *words(9, 200 + k), "x", *piece, "y"])))
        rows += [(10 * k + 3, " ".join(["p", *piece, "q", *words(k, 300 + k)])), (10 * k + 3, " ".join([*words(k, 400 + k), "p", *piece, "q"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple(map(str, r))
    got = substring_dedup.dedup(docs).collect()
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute_substrings(rows), key=key)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_substring_dedup"](spark, str(tmp_path)).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_phrases_cover_every_window_once_in_blocks_of_any_size(monkeypatch):
    r = np.random.default_rng(3)
    h = r.integers(0, 9, 900).astype(np.uint64)
    first = np.array([0, 5, 5, 300, 313, 325, 900])
    want = {i for lo, hi in zip(first[:-1], first[1:]) for i in range(lo, hi - 12)}
    anchors = {}
    for block in (1 << 18, 50, 7):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        at = []
        for start, count, anchor, _ in substring_dedup.phrases(h, first):
            for s, c, a in zip(start, count, anchor):
                for i in range(s, s + c):
                    at.append(i)
                    # An equal window has an equal anchor, in blocks of any size.
                    assert anchors.setdefault(h[i : i + 13].tobytes(), a) == a
        assert sorted(at) == sorted(want)


def test_factors_are_greedy_and_follow_one_reference():
    f = substring_dedup.factors(np.array([0, 3, 20]), np.array([3, 2, 1]), np.array([1, 1, 1]), np.array([7, 10, 50]), 13)
    assert f == [(0, 17, 1, 7), (20, 13, 1, 50)]
    assert substring_dedup.factors(np.array([0, 3]), np.array([3, 2]), np.array([1, 2]), np.array([7, 10]), 13) == [(0, 15, 1, 7), (3, 14, 2, 10)]


def aligned(pair, text):
    """By the bytes themselves: which token of each side owns each byte."""
    if not text:
        return None
    a, b = ([x[0] for x in y] for y in pair.encode([text]))
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.a_bytes[i] for i in a) != (" " + text).encode() or b"".join(pair.b_bytes[i] for i in b) != (" " + text).encode():
        return None
    own = [[k for k, i in enumerate(ids) for _ in names[i]] for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes))]
    links = sorted(set(zip(*own)))
    ends = [{sum(len(names[i]) for i in ids[: k + 1]) for k in range(len(ids))} for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes))]
    groups, x, y, at_a, at_b = [], [], [], 0, 0
    i = j = 0
    for end in sorted(ends[0] & ends[1]):
        while i < len(a) and at_a + len(pair.a_bytes[a[i]]) <= end:
            at_a += len(pair.a_bytes[a[i]])
            x.append(a[i])
            i += 1
        while j < len(b) and at_b + len(pair.b_bytes[b[j]]) <= end:
            at_b += len(pair.b_bytes[b[j]])
            y.append(b[j])
            j += 1
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        x, y = [], []
    return len(a), len(b), groups, [(a[p], b[q]) for p, q in links]


ODD = [
    "The quick brown fox jumps over 12,345 lazy dogs.", "  two  spaces \n \n x ", " lead", "tab\tand ▁ under", "a b c", "<|endoftext|> x </s> <0x41>", "日本語 のテスト ü", "é́ combining ﬁ ligature", "x" * 900, "\n\n", "a \n b", " ",
    None, "", "The quick brown fox", "The quick brown fox", "x y   z", "🙂🙂 emoji 🙂", "\x00 nul \x01", "don't can't I'll", "end ",
]


@pytest.mark.parametrize("frequent", [1 << 17, 4])
def test_alignment_against_owners_of_bytes(spark, frequent):
    pair = alignment._pair(*alignment.default_tokenizers())
    docs = spark.createDataFrame([(k if k else None, t, "x", 0) for k, t in enumerate(ODD)], "doc_id long, text string, pairs string, row int")
    got = {r.doc_id: r for r in alignment.align(docs, with_groups=True, frequent=frequent).collect()}
    want = [aligned(pair, t) for t in ODD]
    count = {}
    for w in want:
        for p in set(w[3]) if w else ():
            count[p] = count.get(p, 0) + 1
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    assert any(w is None and t for w, t in zip(want, ODD)) and len(got) == len(ODD)
    for k, w in enumerate(want):
        r = got[k if k else None]
        if w is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", "")
            continue
        text = ";".join(w[2])
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (w[0], w[1], len(w[2]), len(w[3]), text)
        assert r.groups_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.count_sum == sum(count[p] for p in w[3]) and r.n_best == sum(count[p] == top[p[0]] for p in w[3])
        assert set(w[3]) <= set(alignment.products(text))
    assert alignment.align(docs.limit(0)).count() == 0


def test_alignment_keeps_no_more_than_its_bound_and_alike_when_it_forgets(monkeypatch):
    pair = alignment.Pair(*alignment.default_tokenizers())
    texts = [" ".join(words(40, k)) for k in range(20)]
    want = [pair.align([t])[0] for t in texts]
    monkeypatch.setattr(alignment, "KNOWN", 10)
    assert [next(pair.documents([t])) for t in texts] == want
    pair.cuts = False
    assert list(pair.documents(texts)) == want


def brute_negatives(rows, every=50):
    rows = [(k, i, lab, np.array(q, object)) for k, (i, lab, q) in enumerate(rows)]
    out = []
    for k, i, lab, q in rows:
        if i % every:
            continue
        scored = sorted((-int(q @ x), j, n, m) for n, j, m, x in rows if n != k)
        for s, j, _, _ in [x for x in scored if x[3] == lab][:5]:
            hard = [(-t, x) for t, x, _, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, x, -s, t) for r, (t, x) in enumerate(hard[:3])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 2e10])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, scale):
    for name, small in (("BUCKET", 16), ("ANCHORS", 3), ("FIRST", 2), ("SLICE", 4)):
        monkeypatch.setattr(hard_negatives, name, small)
    r = np.random.default_rng(7)
    x = r.normal(size=(240, 6)) * (r.pareto(2, (240, 1)) + 0.2) * scale
    x[50:60] = x[40]  # ties
    rows = [(int(k) * (5 if k % 3 else 1), int(r.integers(0, 4)), list(map(float, v))) for k, v in enumerate(x)]
    rows += [rows[9], rows[0], rows[50]]  # repeated rows, an anchor among them
    odd = [(None, 1, [1.0] * 6), (700, None, [1.0] * 6), (750, 1, None), (800, 1, [1.0, None] * 3), (850, 1, [float("nan")] * 6), (900, 1, [float("inf")] * 6), (950, 1, [1.0]), (1000, 1, [])]
    data = spark.createDataFrame([(*x, "s") for x in rows + odd], "vec_id long, label int, embedding array<double>, row string")
    v = hard_negatives.quantised(data)
    sound = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * c)) for c in q]) for i, lab, q in rows]
    got = hard_negatives.mine(v).collect()
    want = brute_negatives(sound)
    if scale < 1e10:
        assert want and sorted(map(tuple, got)) == want
    else:  # scores beyond a long: the nearest longs
        assert all(abs(r.negative_score) < 1 << 63 for r in got)
    assert hard_negatives.mine(v.limit(0)).count() == 0


def test_common_and_rare_lines_are_found_in_one_pass_over_the_documents(spark, tmp_path):
    """A line that is most of all lines, lines that come twice, blank and padded ones: every repeat goes, and the documents are read once for both joins."""
    r = random.Random(5)
    rare = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=30)) for _ in range(1100)]
    lines = rare + ["The common line"] * 900 + [f"  {x.upper()}\t" for x in rare[::2]] + ["", " \t"]
    r.shuffle(lines)
    rows = [(k, "\n".join(lines[50 * k : 50 * k + 50])) for k in range(len(lines) // 50 + 1)]
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    out = line_dedup.repeats(spark.read.parquet(path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count(",text#") == 1
    seen, want = set(), set()
    for doc_id, text in rows:
        for at, line in enumerate(text.split("\n")):
            key = line.strip().lower()
            if key in seen:
                want.add((doc_id, at))
            seen.update([key] * bool(key))
    assert {tuple(x) for x in out.collect()} == want and len(want) > 1400
