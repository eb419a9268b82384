"""Every production of printed addresses, and generated lists read back."""

import random

from pyspark.sql import functions as F

from chronofold.functions import surface as sf

CASES = {
    "các điểm a, b, c và đ khoản 1 Điều 39": [["dieu:39/khoan:1/diem:a", "dieu:39/khoan:1/diem:b", "dieu:39/khoan:1/diem:c", "dieu:39/khoan:1/diem:đ"]],
    "khoản 8, khoản 9 và khoản 10 Điều 8": [["dieu:8/khoan:8", "dieu:8/khoan:9", "dieu:8/khoan:10"]],
    "điểm a khoản 1, điểm b khoản 2 Điều 20": [["dieu:20/khoan:1/diem:a", "dieu:20/khoan:2/diem:b"]],
    "Điều 19, 20 và 21": [["dieu:19", "dieu:20", "dieu:21"]],
    "điểm a1 khoản 1a Điều 24a": [["dieu:24a/khoan:1a/diem:a1"]],
    "Phụ lục 01 và Phụ lục số 02": [["phuluc:01", "phuluc:02"]],
    "tiết a(iii) khoản 2 Điều 5": [["dieu:5/khoan:2/diem:a/tiet:iii"]],
    "tiết (i) điểm b khoản 1": [["khoan:1/diem:b/tiet:i"]],
    "quy định tại khoản 3 Điều 7 áp dụng cùng khoản 1 Điều 13": [["dieu:7/khoan:3"], ["dieu:13/khoan:1"]],
    "khoản 1 hoặc 2; và Điều 3": [["dieu:3/khoan:1", "dieu:3/khoan:2"]],
    "điểm c và điểm d khoản 2 Điều 13": [["dieu:13/khoan:2/diem:c", "dieu:13/khoan:2/diem:d"]],
    "khoản 1, khoản 1 Điều 2": [["dieu:2/khoan:1"]],
    "Tổ chức tín dụng không được cho vay": [], "Điều này": [], "": [],
}
BINDINGS = {
    "khoản 2 Điều 8 Thông tư số 39/2016/TT-NHNN.": ("Thông tư số 39/2016/TT-NHNN", False, None),
    "khoản 8 Điều 8 của Thông tư số 39/2016/TT-NHNN": ("Thông tư số 39/2016/TT-NHNN", False, None),
    "Điều 468 Bộ luật Dân sự ngày 24 tháng 11 năm 2015": ("Bộ luật Dân sự ngày 24 tháng 11 năm 2015", False, None),
    "Điều 5 Bộ luật Dân sự năm 2015": ("Bộ luật Dân sự năm 2015", False, None),
    "Điều 1 Quyết định 1058/QĐ-TTg": ("Quyết định 1058/QĐ-TTg", False, None),
    "khoản 2 Điều 2 Thông tư này": (None, True, None),
    "khoản 5 Điều này": (None, False, "dieu"),
    "điểm a của khoản này": (None, False, "khoan"),
    "Điều 4, Thông tư khác": (None, False, None),
}


def parsed(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.g for r in df.select("t", sf.references(F.col("t")).alias("g")).collect()}


def test_every_production(spark):
    got = parsed(spark, [*CASES, *BINDINGS, None])
    assert got.pop(None) is None
    for t, paths in CASES.items():
        assert [g.paths for g in got[t]] == paths, t
        assert all(g.raw == t[g.start : g.stop].strip() for g in got[t])
    for t, want in BINDINGS.items():
        assert len(got[t]) == 1 and (got[t][0].document, got[t][0].this, got[t][0].relative) == want, t
    inner = "khoản 1 Điều 2 Thông tư sửa đổi khoản 9 Điều 9 số 39/2016/TT-NHNN và Điều 3"
    assert [g.paths for g in parsed(spark, [inner])[inner]] == [["dieu:2/khoan:1"], ["dieu:3"]]


def test_generated_lists_read_back(spark):
    r = random.Random(4)
    made = {}
    for _ in range(300):
        groups = []
        for _ in range(r.randrange(1, 4)):
            clauses = [(k, r.sample("abcdđeghk", r.randrange(4))) for k in r.sample(range(1, 30), r.randrange(1, 4))]
            groups.append((r.randrange(1, 200), clauses))
        say = lambda xs: ", ".join(xs[:-1]) + (r.choice([" và ", ", ", " hoặc "]) if len(xs) > 1 else "") + xs[-1]
        text = " theo quy định và ".join(say([(r.choice(["điểm ", "các điểm "]) + say(p) + " " if p else "") + f"khoản {k}" for k, p in cs]) + f" Điều {d}" for d, cs in groups)
        paths = [[f"dieu:{d}/khoan:{k}" + (f"/diem:{x}" if x else "") for k, p in cs for x in (p or [""])] for d, cs in groups]
        # A clause alone after a point's clause: chains close at the first higher unit, as in print.
        if all(p or not any(q for _, q in cs[:i]) for _, cs in groups for i, (_, p) in enumerate(cs)):
            made[text] = paths
    got = parsed(spark, made)
    assert len(made) > 100
    for t, want in made.items():
        assert [g.paths for g in got[t]] == want, t


def test_sentence_around_a_place(spark):
    text = "Một câu. Hai câu; ba\nBốn: năm 1.5 phần"
    at = [0, 9, 12, 18, 21, 25, 33]
    got = spark.createDataFrame([(text, a) for a in at], "t string, a int").select(sf.sentence_at(F.col("t"), F.col("a")).alias("s")).collect()

    def plain(p):
        start = max(text.rfind("\n", 0, p), text.rfind(". ", 0, p)) + 1
        stop = min([i for i in (text.find(";", p), text.find("\n", p)) if i >= 0], default=len(text))
        return text[start:stop].strip()

    assert [r.s for r in got] == [plain(a) for a in at]
