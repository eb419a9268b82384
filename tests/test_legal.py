import datetime as dt
import random

from pyspark.sql import functions as F

from chronofold.functions import legal as lg
from chronofold.functions import text as tx
from chronofold.operators import desk


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def brute_chunks(text, size=24):
    out, held = [], ""
    for w in text.split(" "):
        held += w + " "
        if len(held) >= size:
            out.append(held)
            held = ""
    return out + ([held[:-1]] if held else [])


def test_chunks_are_whole_and_close_at_the_size(spark):
    for text in ("", "a", "one two three four five six seven eight", "x" * 60 + " y  z ", "exactly twenty three cha "):
        got = one(spark, text, lg.chunks)
        assert got == brute_chunks(text) and "".join(got) == text


def test_numbers_dates_and_quotes(spark):
    assert one(spark, "theo 32 /2026/TT- NHNN, ngày 16/6/2010", lg.glue_numbers) == "theo 32/2026/TT-NHNN, ngày 16/6/2010"
    assert one(spark, "32 /2026/tt - nhnn và 1/2/2020", lg.loose_numbers) == ["32/2026/TT-NHNN"]
    assert one(spark, "ngày 31 tháng 2 năm 2020", lg.parse_date) is None and one(spark, "x", lg.parse_date) is None
    assert one(spark, "từ ngày 1/7/2024", lg.parse_date) == dt.date(2024, 7, 1)
    assert one(spark, " “abc”. ", lg.unquote) == "abc" and one(spark, '"', lg.unquote) == '"' and one(spark, None, lg.unquote) is None
    assert one(spark, "c", tx.next_letter) == "d" and one(spark, "d", tx.next_letter) == "đ" and one(spark, "y", tx.next_letter) is None
    assert one(spark, "tối đa 5,5 % / năm; không vượt quá mức 7%/năm", lg.rates) == [5.5, 7.0]
    assert one(spark, "Đường ữ", lg.strip_diacritics) == "Duong u" and one(spark, None, lg.normalize_text) == ""


def test_as_of_and_signing_bounds(spark):
    today = F.lit("2024-06-01").cast("date")
    cases = {
        "ngay 1 thang 6 nam 2024": ("2024-06-01", "current"), "31/2/2020 roi nam 2019": ("2019-12-31", "point_in_time"), "thang 2/2024": ("2024-02-29", "point_in_time"),
        "hien nay": ("2024-06-01", "current"), "sap toi": ("2024-06-01", "pending"), "": ("2024-06-01", "current"),
    }
    for q, (day, mode) in cases.items():
        got = one(spark, q, lambda c: lg.as_of(c, today))
        assert (str(got.as_of), got.mode) == (day, mode), q
    bounds = {"ky truoc 1/7/2024": "2024-07-01", "ky ngay 31/12/2023": "2024-01-01", "ky thang 12/2023": "2024-01-01", "ky nam 2020": "2021-01-01", "": "None"}
    for q, day in bounds.items():
        assert str(one(spark, q, lg.signed_before)) == day, q


def test_answer_events(spark):
    a = spark.createDataFrame([(1, ["x ", "y"], None, ["b"], "A")], "id int, tokens array<string>, citations array<string>, banners array<string>, tier string")
    assert [(r.event, r.data) for r in desk.answer_events(a).orderBy("ord").collect()] == [("meta", "1"), ("token", "x "), ("token", "y"), ("banner", "b"), ("tier", "A"), ("done", "")]


OP = "doc_id int, seq int, kind string, path string, surface string, part string, new_text string, valid_from date, valid_to_event string, scope string, confidence double, extractor string, notes string"


def plain_merge(rules, others):
    """Operator by operator."""
    key = lambda o: (o["doc_id"], o["kind"], o["path"] or (o["surface"] or "").lower(), o["part"])
    out, ruled = {}, set()
    for o in sorted(rules, key=lambda o: o["seq"]):
        out[key(o)] = o | {"agree": False, "red_flags": []}
        ruled.add(key(o))
    for o in sorted(others, key=lambda o: o["seq"]):
        have = out.get(key(o))
        if have is None:
            out[key(o)] = o | {"agree": False, "red_flags": []}
            continue
        have["confidence"] = max(have["confidence"], o["confidence"])
        if key(o) in ruled:
            have |= {"agree": True, "extractor": have["extractor"] + "+" + o["extractor"], "valid_to_event": have["valid_to_event"] or o["valid_to_event"], "scope": have["scope"] or o["scope"]}
            if o["notes"] == desk.ON_AMENDMENT:
                have["notes"] = o["notes"]
            if o["valid_from"] and have["valid_from"] and o["valid_from"] != have["valid_from"]:
                have["red_flags"] = have["red_flags"] + [desk.DATE_FLAG]
    return sorted((tuple(str(x) for x in o.values()) for o in out.values()))


def test_merge_is_that_of_one_operator_after_another(spark):
    r = random.Random(3)
    names = [x.split()[0] for x in OP.split(", ")]
    op = lambda k, who: dict(zip(names, (r.randrange(2), k, r.choice(["amend", "repeal"]), r.choice([None, "dieu:1", "dieu:2"]), r.choice(["Điều 1", "điều 1", "Điều 3"]), r.choice(["body", "heading"]), r.choice([None, f"{who}{k}"]), r.choice([None, dt.date(2024, 1, 1), dt.date(2024, 2, 1)]), r.choice([None, f"e{k}"]), r.choice([None, "bank"]), k / 64, who, r.choice([None, "x", desk.ON_AMENDMENT]))))
    rules, others = [op(k, "rule") for k in range(14)], [op(k, f"m{k}") for k in range(30)]
    frame = lambda ops: spark.createDataFrame([tuple(o.values()) for o in ops], OP)
    got = desk.merge_extractions(frame(rules), frame(others)).collect()
    assert sorted(tuple(str(x[c]) for c in [*names, "agree", "red_flags"]) for x in got) == plain_merge(rules, others)
    assert sum(x.agree for x in got) > 2 and not any(x.agree for x in desk.merge_extractions(frame(rules), frame(others), False).collect())


def test_a_contract_is_read_and_cut_before_the_time(spark):
    cases = {
        "khoan vay ky truoc 1/7/2023 lai suat hien nay": ("2023-07-01", None, None, "2024-05-05"), "ky ket ngay 2 / 3 / 2022, chua sua doi tu 1/1/2020, tai 5/6/2021": ("2022-03-03", "2020-01-01", None, "2021-06-05"),
        "khach hang la ca nhan ky thang 12/2021 nam 2022": ("2022-01-01", None, "ca_nhan", "2022-12-31"), "doanh nghiep vay chua sua doi": (None, "1900-01-01", "phap_nhan", "2024-05-05"), "tai 1/7/2023": (None, None, None, "2023-07-01"),
    }
    today = F.lit("2024-05-05").cast("date")
    for q, want in cases.items():
        c, t = one(spark, q, lg.cohort), one(spark, q, lambda c: lg.as_of(lg.without_cohort(c), today))
        assert (*(str(x) if x else None for x in c), str(t.as_of)) == want, q
