"""Addresses, names of documents and containment against plain loops."""

import datetime as dt
import random

from chronofold.operators import address as ad
from chronofold.operators import contain as ct

D = dt.date


def day(k):
    return D(2020, 1, 1) + dt.timedelta(days=k)


def plain(ask, aliases, nodes, ancestors):
    _, doc, path, at = ask
    tries = ["/".join(path.split("/")[: k + 1]) for k in range(path.count("/"), -1, -1)] if ancestors else [path]
    for p in tries if at else []:
        rows = {x for x in aliases if x[:2] == (doc, p)}
        now = [x for x in rows if x[3] <= at and (x[4] is None or at < x[4])]
        if now:
            last = [x for x in now if x[3] == max(y[3] for y in now)]
            return (last[0][2], "covered" if p == path else "ancestor", p) if len(last) == 1 else (None, "tied", p)
        for step, found in (("future", [x[2] for x in rows if x[3] > at]), ("provisional", [n for n, *a in set(nodes) if a == [doc, p]])):
            if len(found) == 1:
                return found[0], step if p == path else "ancestor", p
    return None, None, None


def test_resolution_is_the_plain_cascade(spark):
    r = random.Random(8)
    paths = ["dieu:1", "dieu:1/khoan:1", "dieu:1/khoan:2", "dieu:2", "dieu:2/khoan:1/diem:a"]
    aliases = [(r.choice("AB"), r.choice(paths), f"n{k}", day(r.randrange(40)), None if r.random() < 0.4 else day(r.randrange(20, 60))) for k in range(16)]
    aliases += [aliases[0]]
    nodes = [(f"b{k}", r.choice("ABC"), r.choice(paths)) for k in range(9)] + [("b0", "C", "dieu:2")]
    asks = [(k, r.choice("ABC"), r.choice(paths), day(r.randrange(60)) if k % 17 else None) for k in range(200)]
    frames = [spark.createDataFrame(x, s) for x, s in ((asks, "ask_id int, doc_key string, path string, at date"), (aliases, "doc_key string, path string, node_id string, valid_from date, valid_to date"), (nodes, "node_id string, doc_key string, path string"))]
    seen = set()
    for ancestors in (False, True):
        got = {x.ask_id: (x.node_id, x.how, x.path) for x in ad.resolve(*frames, ancestors=ancestors).collect()}
        want = {a[0]: plain(a, aliases, nodes, ancestors) for a in asks}
        assert got == want
        seen |= {w[1] for w in want.values()}
    assert seen >= {"covered", "future", "provisional", "ancestor", None}
    tie = spark.createDataFrame([("A", "p", "x", day(0), None), ("A", "p", "y", day(0), None)], frames[1].schema)
    assert [tuple(x) for x in ad.resolve(spark.createDataFrame([(1, "A", "p", day(5))], frames[0].schema), tie, frames[2]).collect()] == [(1, None, "tied", "p")]


def test_documents_by_number_date_and_title(spark):
    docs = spark.createDataFrame([("39/2016/TT", day(1), "Thông tư về Cho vay"), ("06/2023/TT", day(2), "Thông tư sửa đổi"), ("7/2020/L", day(2), "Luật Các tổ chức tín dụng"), ("8/2021", None, "ngắn"), ("9/2022", day(9), None)], "doc_key string, issued date, title string")
    asks = [(1, "39/2016/TT", None, None), (2, "1/1", day(1), "cho vay"), (3, None, day(1), None), (4, None, day(2), "các TỔ chức"), (5, None, None, "theo  luật các tổ chức tín dụng năm"), (6, None, None, "thông tư"), (7, None, None, "trong ngắn hạn"), (8, "", None, "vay"), (9, None, None, None), (10, None, None, "ơ")]
    got = {x.ask_id: x.doc_key for x in ad.find_document(spark.createDataFrame(asks, "ask_id int, number string, issued date, hint string"), docs).collect()}
    assert got == {1: "39/2016/TT", 2: None, 3: "39/2016/TT", 4: "7/2020/L", 5: "7/2020/L", 6: None, 7: None, 8: "39/2016/TT", 9: None, 10: None}
    short = spark.createDataFrame([(1, "39"), (2, "006"), (3, "5"), (4, None)], "ask_id int, number string")
    keys = docs.unionByName(spark.createDataFrame([("05/1", None, ""), ("5/2", None, "")], docs.schema))
    assert {x.ask_id: x.doc_key for x in ad.resolve_shorthand(short, keys).collect()} == {1: "39/2016/TT", 2: "06/2023/TT", 3: None, 4: None}


def test_containment_is_that_of_all_pairs(spark):
    r = random.Random(3)
    texts = [(k, "".join(r.choices("ab cđ", k=r.randrange(14)))) for k in range(60)] + [(99, None)]
    patterns = [(k, "".join(r.choices("ab cđ", k=r.randrange(6)))) for k in range(60)] + [(99, None)]
    got = {tuple(x) for x in ct.containing(spark.createDataFrame(patterns, "pattern_id int, pattern string"), spark.createDataFrame(texts, "text_id int, text string")).collect()}
    assert got == {(i, j) for i, p in patterns for j, t in texts if p and t is not None and p in t}


def test_terms_are_found_in_their_own_document(spark):
    rows = [
        (1, "khoan", "dieu:1/khoan:1", "definition", None, "Cho vay là việc"), (1, "khoan", "dieu:1/khoan:2", "definition", None, "Nợ xấu được hiểu là x"), (1, "khoan", "dieu:1/khoan:3", "definition", None, "Vay lại bao gồm y"),
        (1, "dieu", "dieu:2", "rule", "CHO VAY", ""), (1, "dieu", "dieu:3", "amending", None, "cho vay"), (1, "preamble", "preamble", "rule", None, "cho vay"), (1, "khoan", "dieu:4/khoan:1", "rule", None, "tỷ lệ nợ xấu và cho vay lại"),
        (2, "dieu", "dieu:1", "rule", None, "cho vay"), (2, "khoan", "dieu:5/khoan:1", "definition", None, "Lãi là x"),
    ]
    got = {tuple(x) for x in ct.term_edges(spark.createDataFrame(rows, "doc_id int, level string, path string, role string, heading string, body string")).collect()}
    assert got == {(1, "dieu:2", "cho vay", "dieu:1/khoan:1"), (1, "dieu:4/khoan:1", "cho vay", "dieu:1/khoan:1"), (1, "dieu:4/khoan:1", "nợ xấu", "dieu:1/khoan:2"), (1, "dieu:4/khoan:1", "vay lại", "dieu:1/khoan:3")}
