"""Every kind of amendment, generated directives read back, and replacements in their order."""

import datetime as dt
import random

from chronofold.operators import amend as am
from chronofold.sources import scratch

C = "doc_id int, path string, text string, effective date"
DAY = dt.date(2024, 9, 1)


def read(spark, texts):
    rows = [(k, "dieu:1", t, DAY) for k, t in enumerate(texts)]
    got = {}
    for o in sorted(am.operators(spark.createDataFrame(rows, C)).collect(), key=lambda o: (o.doc_id, o.seq)):
        got.setdefault(o.doc_id, []).append(o)
    return [got.get(k, []) for k in range(len(texts))]


def test_each_kind(spark):
    texts = [
        "Bổ sung khoản 8, khoản 9 và khoản 10 Điều 8 Thông tư số 39/2016/TT-NHNN như sau:\n“8. Để gửi tiền.\na) điểm\n9. Hai\n10. Ba”.",
        "Sửa đổi, bổ sung khoản 2 Điều 8 như sau:\n“2. Mới: bãi bỏ khoản 1 Điều 3”", "Thay thế cụm từ “A b” bằng cụm từ “C” tại khoản 1, khoản 2 Điều 5; điểm a", "Thay thế cụm từ \"x\" bằng \"y\"",
        "1. Bãi bỏ điểm a và điểm b khoản 1 Điều 7 kể từ ngày 01/10/2024.", "Ngưng hiệu lực thi hành khoản 8, khoản 9 Điều 8 Thông tư số 39/2016/TT-NHNN từ ngày 1 tháng 9 năm 2023 cho đến ngày có hiệu lực của văn bản mới", "Sửa đổi khoản 1 và khoản 2 Điều 3 như sau: “1. Chỉ một”", "Sửa đổi khoản 1 Điều 3\n“1. Xuống dòng”", "Không sửa gì", None, "Bãi bỏ mọi thứ",
    ]
    insert, amend, phrase, bare, repeal, suspend, half, below, *rest = read(spark, texts)
    assert [(o.kind, o.target_path, o.document, o.new_text) for o in insert] == [("insert", f"dieu:8/khoan:{k}", "Thông tư số 39/2016/TT-NHNN", t) for k, t in ((8, "8. Để gửi tiền.\na) điểm"), (9, "9. Hai"), (10, "10. Ba"))]
    assert [(o.kind, o.target_path, o.new_text, o.valid_from) for o in amend] == [("amend", "dieu:8/khoan:2", "2. Mới: bãi bỏ khoản 1 Điều 3", DAY)]
    assert [(o.kind, o.target_path, o.phrase_from, o.phrase_to) for o in phrase] == [("amend", f"dieu:5/khoan:{k}", "A b", "C") for k in (1, 2)]
    assert [(o.target_path, o.red_flags, o.confidence, o.phrase_from) for o in bare] == [(None, [am.NO_TARGET], 0.3, "x")]
    assert [(o.kind, o.target_path, str(o.valid_from)) for o in repeal] == [("repeal", f"dieu:7/khoan:1/diem:{p}", "2024-10-01") for p in "ab"]
    assert [(o.kind, o.target_path, str(o.valid_from), o.valid_to, o.valid_to_event) for o in suspend] == [("suspend", f"dieu:8/khoan:{k}", "2023-09-01", None, "đến ngày có hiệu lực của văn bản mới") for k in (8, 9)]
    assert [(o.target_path, o.new_text, o.red_flags) for o in half] == [("dieu:3/khoan:1", "1. Chỉ một", []), ("dieu:3/khoan:2", None, [am.NO_UNIT])]
    assert [(o.kind, o.target_path, o.new_text) for o in below] == [("amend", "dieu:3/khoan:1", "1. Xuống dòng")]
    assert rest == [[], [], []]


def test_generated_amendments_are_read_back(spark):
    r = random.Random(9)
    texts, want = [], []
    for _ in range(120):
        parts, ops = [], []
        for _ in range(r.randrange(1, 4)):
            d, ks = r.randrange(1, 90), sorted(r.sample(range(1, 30), r.randrange(1, 4)))
            spec = ", ".join(f"khoản {k}" for k in ks) + f" Điều {d}"
            kind = r.choice(["insert", "amend", "repeal", "phrase"])
            if kind in ("insert", "amend"):
                word = {"insert": "Bổ sung", "amend": "Sửa đổi, bổ sung"}[kind]
                parts.append(f"{word} {spec} như sau:\n“" + "\n".join(f"{k}. nội dung {k} bãi bỏ khoản 3 Điều 4" for k in ks) + "”.")
                ops += [(kind, f"dieu:{d}/khoan:{k}", f"{k}. nội dung {k} bãi bỏ khoản 3 Điều 4", None) for k in ks]
            elif kind == "repeal":
                parts.append(f"Bãi bỏ {spec}.")
                ops += [(kind, f"dieu:{d}/khoan:{k}", None, None) for k in ks]
            else:
                parts.append(f"Thay thế cụm từ “cũ {d}” bằng “mới” tại {spec}.")
                ops += [("amend", f"dieu:{d}/khoan:{k}", None, f"cũ {d}") for k in ks]
        texts.append("\n".join(parts))
        want.append(ops)
    for t, got, ops in zip(texts, read(spark, texts), want):
        assert [(o.kind, o.target_path, o.new_text, o.phrase_from) for o in got] == ops, t


def test_replacements_meet_the_text_as_amended(spark):
    r = random.Random(1)
    bodies = {f"n{k}": "".join(r.choices("ab", k=8)) for k in range(6)}
    ops = [(k, r.choice([*bodies, "lost"]), k, r.choice(["a", "ab", "ba", "", None]), r.choice(["b", "aa", "", None])) for k in range(60)]
    got = am.materialise(spark.createDataFrame(ops, "op_id int, node_id string, seq int, phrase_from string, phrase_to string"), spark.createDataFrame(list(bodies.items()), "node_id string, body string")).collect()
    now, want = dict(bodies), set()
    for k, n, _, a, b in ops:
        old = now.get(n, "")
        found = bool(a) and a in old
        now[n] = old.replace(a, b or "") if found else old
        want.add((n, k, old, now[n], found))
    assert {tuple(x) for x in got} == want


def test_equal_texts_are_read_once(spark):
    """Rows that directives are looked for in are distinct texts; each clause still has its own operators and date."""
    text = "Bãi bỏ khoản 1 Điều 2; sửa đổi khoản 3 Điều 4 như sau: “3. Ba”"
    day = lambda i: dt.date(2024, 1, 1 + i % 28)
    rows = [(i, p, text, day(i)) for i in range(300) for p in ("dieu:1", "dieu:2")] + [(999, "dieu:1", None, day(1)), (0, "dieu:3", "Bãi bỏ khoản 5 Điều 6 từ ngày 1/3/2025.", None)]
    got = am.operators(spark.createDataFrame(rows, C)).collect()
    own = lambda d: sorted((o.seq, o.source_path, o.kind, o.target_path, o.valid_from) for o in got if o.doc_id == d)
    assert own(0)[-1] == (5, "dieu:3", "repeal", "dieu:6/khoan:5", dt.date(2025, 3, 1)) and own(999) == []
    assert own(7) == [(k + 1, f"dieu:{k // 2 + 1}", *(("repeal", "dieu:2/khoan:1"), ("amend", "dieu:4/khoan:3"))[k % 2], day(7)) for k in range(4)]
    assert len(got) == 1201
    read = []
    before, am.stage = am.stage, lambda df: read.append(scratch.stage(df)) or read[-1]
    try:
        am.operators(spark.createDataFrame(rows, C))
    finally:
        am.stage = before
    assert [r.count() for r in read] == [2]
