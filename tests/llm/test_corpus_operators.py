"""Each corpus operator against a brute-force version or a round trip, with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, graph, jaccard_join, lang_id, license_scan, line_dedup, media_jpeg, packing, pii, suffix_dedup, toxicity

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(7)}" for _ in range(n))


def texts():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    passage = words(20, 9)
    return {
        1: base, 2: base, 3: " ".join(near), 4: words(90, 2) + "\n" + passage, 5: passage + "\n" + words(70, 3), 6: None, 7: "", 8: "   \n\t ",
        9: "One", 10: "Tiếng Việt có dấu " * 9, 11: words(4000, 4, 30), 12: "é" * 150, 13: "12.5% !!! ###",
    }


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in texts().items()], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jpeg_carrier_round_trip(spark, docs, empty):
    got = {r.doc_id: r for r in media_jpeg.carry_texts(docs, keep_media=True).collect()}
    for k, t in texts().items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert got[1].feature == got[2].feature and media_jpeg.carry_texts(empty).count() == 0
    data = spark.createDataFrame([(1, bytes(got[4].media)), (2, b"no image"), (3, None)], "id long, data binary")
    t = {r.id: r for r in media_jpeg.tensors(data).collect()}
    assert len(t[1].rgb) == t[1].height * t[1].width * 3 and t[2].rgb is None and t[3].rgb is None


def test_progressive_scans_read_alike_as_arrays_and_bit_by_bit(monkeypatch):
    payload = np.random.default_rng(5).integers(0, 256, 64 * 11, dtype=np.uint8).tobytes()
    media = media_jpeg.carry(payload, len(payload))
    fast = media_jpeg.parse(media)
    monkeypatch.setattr(media_jpeg, "_scan", media_jpeg._scan_bits)
    slow = media_jpeg.parse(media)
    assert all((a.coef == b.coef).all() for a, b in zip(fast.components, slow.components))
    assert media_jpeg.carried(slow) == payload


def test_runs_of_zeros_in_progressive_scans():
    """A hand-made grey image: DC, an AC scan with runs and an end-of-band run, and its refinement."""
    bits = "0" + "1" + "0" * 1  # placeholder of the DC code below
    del bits
    seg = media_jpeg._segment
    tables = seg(0xC4, bytes([0x00, 1, *[0] * 15, 0])) + seg(0xC4, bytes([0x10, 0, 3, *[0] * 14, 0x21, 0x10, 0x00]))
    # AC codes 00: run 2 size 1; 01: end of band for 2..3 blocks; 10: end of block.
    ac = "00" + "1" + "01" + "0"  # block 0: two zeros, +1, then the band ends for two blocks in all
    pad = lambda s: int(s.ljust(-(-len(s) // 8) * 8, "1"), 2).to_bytes(-(-len(s) // 8), "big")
    sos = lambda ss, se, a: seg(0xDA, bytes([1, 1, 0, ss, se, a]))
    image = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + tables + sos(0, 0, 0) + pad("00") + sos(1, 63, 1) + pad(ac) + sos(1, 63, 0x10) + pad("10" + "1" + "10") + b"\xff\xd9"
    frame = media_jpeg.parse(image)
    coef = frame.components[0].coef
    assert coef[0][media_jpeg.ZIGZAG[3]] == 3 and np.count_nonzero(coef) == 1
    assert media_jpeg.decode(image).shape == (8, 16, 3)


def test_pseudonyms_keep_formats_and_links(docs, empty):
    p, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    text = "a.b@x.org, 10.1.2.3, +1 (152) 555-8590, 4785380592391139, DE89 3704 0044 0532 0130 00, 123-45-6789, 2024-02-29, 1234567890123456, 2024-02-30"
    new, found = p.replace(text)
    assert [x[0] for x in found] == ["email", "ipv4", "phone", "card", "iban", "ssn", "date"]
    assert back.replace(new)[0] == text and new.endswith("1234567890123456, 2024-02-30")
    card = next(x[3] for x in found if x[0] == "card")
    assert pii.luhn_digit(card[:-1]) == card[-1]
    f = pii.Feistel(b"k", "t", 777)
    assert sorted(map(f.encrypt, range(777))) == list(range(777))
    out = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    assert all(out[k].text == t and out[k].n_found == 0 for k, t in texts().items()) and pii.pseudonymise(empty, b"k").count() == 0


def brute_windows(rows, width=100):
    seen, out = set(), {}
    for k, t in sorted(rows.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_all_windows(docs, empty, monkeypatch):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute_windows(texts()) and suffix_dedup.dedup(empty).count() == 0


def test_decontamination_against_word_windows(spark, docs, empty):
    t = texts()
    items = {1: " ".join(t[1].split()[10:40]), 2: "never seen " * 9, 3: t[9], 4: None, 5: "", 6: " ".join(t[4].split()[88:95])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    wins = defaultdict(set)
    for i, x in items.items():
        w = ALNUM.findall(low(x))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(str(i))
    want = {}
    for k, x in t.items():
        w, hit, found = ALNUM.findall(low(x)), set(), set()
        for n in {len(p) for p in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        want[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    assert got == want and any(v[4] for v in want.values())
    decontaminate.BLOCK_BYTES, old = 40, decontaminate.BLOCK_BYTES
    try:
        again = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    finally:
        decontaminate.BLOCK_BYTES = old
    assert again == want
    left = {r.doc_id for r in decontaminate.remove(docs, bench).collect()}
    assert left == {k for k, v in want.items() if not v[4]} and decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def brute_jaccard(rows, k, percent):
    sets = {}
    for d, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in rows}


def chain():
    """Texts each a little further from the first, so that links form a chain, and a list longer than SHORT."""
    base, rows = words(100, 20).split(), {}
    for i in range(24):
        rows[100 + i] = " ".join(base)
        if i % 2:
            base[(i * 7) % 100] = f"new{i}"
    return rows


def test_jaccard_join_against_all_pairs(spark, docs, empty):
    rows = texts() | chain()
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.cluster(df, 3, 90).collect()}
    assert got == brute_jaccard(rows, 3, 90)
    five = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert five == {d for d, (_, c) in brute_jaccard(texts(), 5, 80).items() if c == d}
    assert jaccard_join.cluster(empty).count() == 0


def test_jaccard_join_of_near_copies_below_the_threshold(spark, monkeypatch):
    """Pairs that are looked at stay near the size of a family of near copies, most of which do not link."""
    base, seen = words(100, 77, 10**6).split(), {}
    for m in (400,):
        r = random.Random(m)
        rows = {}
        for i in range(m):
            w = list(base)
            for at in r.sample(range(100), 2):
                w[at] = f"own{i}at{at}"
            rows[i] = " ".join(w)
        made, keep = [], jaccard_join.cut

        def counting(df, drop=None):
            out = keep(df, drop)
            if df.columns == ["a", "b"]:
                made.append(out.count())
            return out

        monkeypatch.setattr(jaccard_join, "cut", counting)
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.cluster(df, 3, 90).collect()}
        monkeypatch.setattr(jaccard_join, "cut", keep)
        assert got == brute_jaccard(rows, 3, 90)
        seen[m] = sum(made)
    assert seen[400] <= 12 * 400


def test_jaccard_join_of_groups_with_one_prefix(spark):
    """Sets that differ only in their commonest shingles share prefix and size."""
    r = random.Random(5)
    common = [f"c{i} d{i} e{i}" for i in range(40)]
    rows = {i: " ".join(r.sample(common, 3)) for i in range(60)}
    for i in range(100, 130):
        own = " ".join(f"rare{i % 3}n{j}" for j in range(45))
        rows[i] = own + " " + " ".join(r.sample(common, 2))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for k, percent in ((3, 80),):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.cluster(df, k, percent).collect()}
        assert got == brute_jaccard(rows, k, percent)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 7), (8, 6), (6, 5)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, 6: 4, 8: 4}
    assert graph.components(edges.limit(0)).count() == 0


def test_toxicity_restores_and_learns(spark, empty):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, words(40, i) + (" you worthless scoundrel" if toxic else " you worthy person")))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "you w0rthl3ss sc0undrel"), (1003, "a s c o u n d r e l here")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert all(got[i].predicted == t for i, t in labels) and len(got) == len(rows)
    assert got[1002].predicted == 1 and got[1003].predicted == 1 and got[1000].predicted == 0 and got[1001].predicted == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert toxicity.score(empty, marks).count() == 0


def test_packing_is_whole_and_tight(docs, empty):
    rows = packing.pack(docs, with_ids=True).collect()
    enc, spans = packing._Encoder(packing.default_tokenizer()), defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
    for k, t in texts().items():
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert sum((list(r.ids) for r in own), []) == enc.full.encode(t or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048
    assert packing.pack(empty).count() == 0


def test_local_search_keeps_pieces_and_never_adds_bins():
    r = random.Random(4)
    for capacity in (50, 2048):
        h = Counter(r.randint(1, capacity) for _ in range(400))
        first = packing.best_fit(h, capacity)
        better = packing.local_search(first, capacity)
        assert sum(better.values()) <= sum(first.values()) and all(sum(b) <= capacity for b in better)
        pieces = Counter()
        for b, n in better.items():
            for s in b:
                pieces[s] += n
        assert pieces == h
    # Best fit leaves three bins here; an exchange empties one.
    assert sum(packing.local_search(Counter({(6, 3): 1, (5, 3): 1, (2, 1): 1}), 10).values()) == 2


def brute_ppm(train, text, order=3):
    seen = defaultdict(Counter)
    for t in train:
        b = bytes(order) + t
        for i in range(order, len(b)):
            for n in range(order + 1):
                seen[b[i - n : i]][b[i]] += 1
    bits, b = 0.0, bytes(order) + text
    for i in range(order, len(b)):
        for n in range(order, -1, -1):
            c = seen.get(b[i - n : i])
            if not c:
                continue
            total, kinds = sum(c.values()), len(c)
            if c[b[i]]:
                bits += np.log2((total + kinds) / c[b[i]])
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_ppm_code_lengths_are_exact(spark, docs, empty):
    train = {"aa": ["the cat and the hat ", "that is the thing"], "bb": ["der hund und die katze", "das ist der weg"]}
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in train.items() for t in ts)], "doc_id long, text string, lang string")
    model = lang_id.fit(df)
    tests = ["the katze", "und die hat", "zzz", "", "ÄÖ the"]
    for t in tests:
        at = np.array([0, len(t.encode())])
        got = model.bits(np.frombuffer(t.encode(), np.uint8), at)[0]
        want = [brute_ppm([x.encode() for x in train[k]], t.encode()) for k in ("aa", "bb")]
        assert np.allclose(got, want, rtol=1e-5)
    out = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    assert out[6].lang_pred == out[7].lang_pred == out[8].lang_pred == out[13].lang_pred == "und" and out[12].lang_pred != "und"
    assert lang_id.identify(empty).count() == 0
    kept = {r.doc_id for r in lang_id.keep_language(spark, docs).collect()}
    assert not kept & {6, 7, 8, 13} and {1, 2, 3} <= kept


def test_line_dedup_on_chosen_lines(spark, docs, empty):
    line = words(30, 50)
    close = line.split()
    close[29] = "end"
    rows = {1: line + "\n" + words(25, 51), 2: line.upper() + "\n\nown line here", 3: " ".join(close) + "\nown line here", 4: None, 5: "", 6: "x", 7: "x"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r["at"]) for r in line_dedup.repeats(df).collect()}
    assert got == {(2, 0), (3, 0), (3, 1), (7, 0)}
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert out == {1: rows[1], 2: "\nown line here", 4: None, 5: "", 6: "x"}
    r = {x.doc_id: (x.n_lines, x.n_removed) for x in line_dedup.report(df).collect()}
    assert r == {1: (2, 0), 2: (3, 1), 3: (2, 2), 4: (0, 0), 5: (1, 0), 6: (1, 0), 7: (1, 1)}
    assert line_dedup.drop_lines(docs).columns == docs.columns and line_dedup.report(empty).count() == 0


def test_license_places_and_fuzzy_spans(spark, empty):
    rows = {1: "See the MIT License, and mit-license; MIT  license.", 2: "GNU General Publc Licence v3", 3: "apache licens", 4: None, 5: "ccby cc by", 6: "mitlicense permit licenses"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 2, 7, "mit")
    assert got[2].base_labels == "" and got[2].labels == "gpl" and 0 < got[2].score < 1 and got[2].fuzzy_spans[0].edits == 2
    assert got[3].labels == "apache" and got[4].n_words == 0 and got[4].first_word is None and got[5].base_labels == "cc-by"
    assert got[6].base_labels == "" and license_scan.scan(empty).count() == 0


def test_repeated_rows_give_repeated_rows(spark, docs):
    twice = docs.unionByName(docs)
    n = 2 * docs.count()
    assert suffix_dedup.dedup(twice).count() == n and jaccard_join.cluster(twice).count() == n and line_dedup.report(twice).count() == n
    assert jaccard_join.keep_one(twice).groupBy("doc_id").count().filter("count > 1").count() == 0
    assert packing.pack(twice).filter(F.col("piece") == 0).count() == n


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def brute_lines(rows):
    """The smallest index linked with each of the lines, by all pairs."""
    sets, root = [grams(x) for x in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [find(x) for x in range(len(rows))]


def test_line_dedup_finds_pairs_among_lines_of_one_template(spark):
    """Most pairs of the family are below the threshold, so no leader stands for the others."""
    r = random.Random(7)
    template, lines = [f"word{i}" for i in range(24)], []
    for i in range(300):
        line = list(template)
        for at in r.sample(range(24), 3):
            line[at] = f"v{i}p{at}"
        lines += [" ".join(line), " ".join(line) + "s"]
    gone = {i for i, up in enumerate(brute_lines(lines)) if up != i}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.repeats(df).collect()}
    assert len(gone) >= 300 and got <= gone and len(got) >= 0.98 * len(gone)


def test_parities_never_call_lines_further_apart_than_they_are(spark):
    lines = [words(n, n) for n in (1, 3, 30, 300)] + [words(30, 30)[:-2] + "zz", "ab"]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    rows = {x.id: x for x in line_dedup.parities(df).collect()}
    for a, x in rows.items():
        assert x.n == len(grams(lines[a]))
        for b, y in rows.items():
            apart = sum(bin((x[f"p{j}"] ^ y[f"p{j}"]) & (1 << 64) - 1).count("1") for j in range(line_dedup.PARITY))
            assert apart <= len(grams(lines[a]) ^ grams(lines[b]))
    got = {x.id: set(x.s) for x in df.select("id", line_dedup.shingles(F.col("norm")).alias("s")).collect()}
    assert all(got[i] == grams(t) for i, t in enumerate(lines))


def test_line_hashes_tell_shingles_apart_as_their_texts_do(spark):
    lines = [words(n, n) for n in (1, 3, 30, 300)] + ["ab", "aaaaaaaaaaaa", "đ" * 7 + "😀" * 3 + "\ufeff" * 3 + "ab", "x\n y" * 3]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    h = {x.id: x.h for x in df.select("id", line_dedup.hashes(F.col("norm")).alias("h")).collect()}
    assert all(len(h[i]) == max(1, len(t) - 4) and len(set(h[i])) == len(grams(t)) for i, t in enumerate(lines))
    some = {x.id: x.h for x in line_dedup.grams(df).groupBy("id").agg(F.collect_list("h").alias("h")).collect()}
    assert all(Counter(some[i]) == Counter(h[i]) for i in h)


def test_line_dedup_takes_extra_columns_of_any_name(spark):
    rows = [(1, "same line here\nx", "a", 1, "b", "c"), (2, "same line here\ny", "d", 2, "e", "f"), (None, "same line here\nz", "g", 3, "h", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, id int, kept string, doc string")
    out = sorted(line_dedup.drop_lines(df).collect(), key=lambda r: r.id)
    assert [(r.doc_id, r.text, r.gone, r.kept, r.doc) for r in out] == [(1, rows[0][1], "a", "b", "c"), (2, "y", "d", "e", "f"), (None, "same line here\nz", "g", "h", "i")]


def test_line_dedup_reads_blank_lines_of_any_kind(spark):
    rows = {1: "first line\r\n\r\nsecond line\r\n\r", 2: "first line\n  \n\u0085\nsecond line", 3: "first line\r\n\r", 4: "a b\n　a b\x85"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {(r.doc_id, r["at"]) for r in line_dedup.repeats(df).collect()} == {(2, 0), (2, 3), (3, 0), (4, 1)}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()} == {1: rows[1], 2: "  \n\u0085", 4: "a b"}


def test_line_dedup_finds_one_changed_letter_in_ordinary_lines(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        line = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxy") for _ in range(r.randrange(4, 8))) for _ in range(12))
        at = r.choice([j for j, ch in enumerate(line) if ch != " "])
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "z" + line[at + 1 :])]
    rows += [(100, "ab"), (101, "cb"), (102, "ab")]
    grams = lambda t: {t[j : j + 5] for j in range(len(t) - 4)}
    near = {b for (_, x), (b, y) in zip(rows[0:80:2], rows[1:80:2]) if 10 * len(grams(x) & grams(y)) >= 8 * len(grams(x) | grams(y))}
    assert len(near) > 35
    got = {x.doc_id for x in line_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= near | {102} and 102 in got and len(got) >= 36


def test_toxicity_reads_every_kind_of_disguise():
    text = "you idiot " * 50 + "your ass is in stupid shit, you are an idiot or a kind person " * 50
    body = ("\0\0" + text + "\0\0").encode()
    c = toxicity._classes()[np.frombuffer(body, np.uint8)]
    channel = toxicity.Channel(np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3))
    for disguised, word in [("idio7", "idiot"), ("a$$", "ass"), ("5h17!", "shit"), ("st00000pid", "stopid"), ("a s s", "ass"), ("y o u i d i o t", "idiot"), ("i" * 20 + "d" * 20 + "iot", "idiot"), ("i.d.i.o.t " * 1 + "x", "idiot"), ("y o u " * 20 + "i d i o t", "idiot")]:
        assert word in channel.restore(f"see {disguised} here").split(), disguised
    assert channel.restore("plain words, (1) 2024!") == "plain words, (1) 2024!" and channel.restore("") == ""


def test_toxicity_readings_are_the_likeliest_of_all():
    rng = random.Random(10)
    channel = toxicity.Channel(np.array([rng.choice([0, 0, 1, 50]) for _ in range(28**3)]))

    def likeliest(token, spaced):
        runs = [m[0] for m in toxicity._RUN.finditer(token)]
        costs = {}
        for parts in itertools.product(*channel.lattice(runs, spaced)):
            text, x, y, total = "".join(parts), 0, 0, 0.0
            for ch in text + " ":
                k = 0 if ch == " " else ord(ch) - 96
                total, x, y = total + channel.cost[x][y][k], y, k
            costs[text] = total
        return costs

    for n, spaced in [(8, False)] * 40 + [(4, True)] * 20:
        token = "".join(rng.choice(["1", "11", "|", "s", "ss", "$$", "3", "aa", "@@", "ll"]) for _ in range(n))
        costs, got = likeliest(token, spaced), channel.decode(token, spaced)
        assert len(set(got)) == len(got) and np.allclose([costs[x] for x in got], sorted(costs.values())[: toxicity.READINGS]), token
    # No length is too long to be read.
    assert re.fullmatch("(worthless?)+", channel.decode("w0rthl3ss" * 9)[0]) and len(channel.decode("a1" * 20_000)[0]) == 40_000


def test_license_notices_with_an_edit_at_an_end():
    fuzzy = license_scan._Fuzzy(license_scan.PHRASES)
    for text, label in [("mit licenses", "mit"), ("mit licensed", "mit"), ("apache licenses", "apache"), ("gnu general public licenses", "gpl")]:
        assert fuzzy.spans(f"the {text}.".encode()) == [(label, 4, 4 + len(text), 1)]
    assert fuzzy.spans(b"permit license") == [] and fuzzy.spans(b"the mit license") == [("mit", 4, 15, 0)]


def test_near_lines_meet_in_one_of_the_bands_they_share(spark):
    from chronofold.llm import line_dedup

    lines = spark.createDataFrame([(1, [11, 12, 13, 14]), (2, [11, 22, 13, 14]), (3, [31, 12, 33, 14]), (4, [41, 42, 43, 44])], "id long, bands array<long>")
    x, y = (lines.select(F.col("id").alias(p + "id"), F.col("bands").alias(p + "bands"), F.explode("bands").alias(p + "band")) for p in ("x", "y"))
    every = x.join(y, (F.col("xband") == F.col("yband")) & (F.col("xid") < F.col("yid")))
    assert every.count() == 6
    met = every.filter(line_dedup.first_shared("x", "y")).select("xid", "yid", "xband").collect()
    assert sorted(map(tuple, met)) == [(1, 2, 11), (1, 3, 12), (2, 3, 14)]
