"""Quotation ratios against all windows; the checks of an answer, one by one."""

import random
from difflib import SequenceMatcher

from chronofold.operators import verify as vf


def slide(quote, text):
    q, t = " ".join(quote.split()), " ".join(text.split())
    if not q or not t:
        return 0.0
    if q.lower() in t.lower():
        return 1.0
    if len(t) <= len(q):
        return SequenceMatcher(None, q.lower(), t.lower()).ratio()
    step = max(10, len(q) // 5)
    best = 0.0
    for s in range(0, len(t) - len(q) + 1, step):
        best = max(best, SequenceMatcher(None, q.lower(), t[s : s + len(q) + step].lower()).ratio())
        if best >= 0.999:
            break
    return best


def test_best_ratio_is_that_of_all_windows():
    r = random.Random(6)
    words = "lãi suất cho vay tối đa KHÔNG vượt quá mười phần trăm một năm İ ß".split()
    for _ in range(400):
        text = " ".join(r.choices(words, k=r.randrange(60)))
        quote = text[(a := r.randrange(len(text) + 1)) : a + r.randrange(90)]
        for _ in range(r.randrange(4)):
            k = r.randrange(len(quote) + 1)
            quote = quote[:k] + r.choice(["x", "", " ", "  đ"]) + quote[k + r.randrange(2) :]
        best = slide(quote, text)
        assert vf.best_ratio(quote, text) == best, (quote, text)
        assert (vf.best_ratio(quote, text, 0.9) >= 0.9) == (best >= 0.9)
    assert vf.best_ratio(None, "a") == 0 and vf.best_ratio("a", None) == 0 and vf.best_ratio("a b", "x A   B") == 1


def test_each_failure_of_an_answer(spark):
    source = "Lãi suất cho vay tối đa không vượt quá 10% một năm theo Điều 5."
    context = [(1, "[1]", source), (1, "[2]", "Khác hẳn 77"), (2, "[1]", None)]
    answers = [(1, "Theo [1] và [9] “lãi suất cho vay tối đa” nhưng “chẳng có trong nguồn nào cả”", ["2024"]), (2, None, None), (3, "[1]", [])]
    claims = [
        (1, "good", "“Lãi suất cho vay tối đa không vượt quá” 10 năm 2024 [1]", ["[1]"]), (1, "near", "“lãi suất cho vay tối đa khong vượt quá 10% một năm theo Điều 5.”", ["[1]", "[2]"]),
        (1, "far", "“lãi suất tiền gửi tối thiểu hoàn toàn khác xa”", ["[1]"]), (1, "digits", "số 0 và 1 và 77", ["[1]"]), (1, "lost", "x", ["[7]"]), (1, "bare", "y", []), (2, "null", "“mười chữ cái ở đây”", ["[1]"]), (2, "none", None, None),
    ]
    frames = [spark.createDataFrame(x, s) for x, s in ((answers, "answer_id int, answer string, numbers array<string>"), (claims, "answer_id int, claim_id string, text string, refs array<string>"), ([(1, "[2]"), (1, "[8]")], "answer_id int, ref string"), (context, "answer_id int, ref string, text string"))]
    got = sorted((x.answer_id, x.claim_id or "", x.kind, x.detail) for x in vf.verify(*frames).collect())
    assert got == sorted([
        (1, "", "ref_outside_context", "[9]"), (1, "", "ref_outside_context", "[8]"), (1, "", "quote_mismatch", "chẳng có trong nguồn nào cả"), (1, "far", "quote_mismatch", "lãi suất tiền gửi tối thiểu hoàn toàn khác xa"),
        (1, "digits", "number_mismatch", "0"), (1, "digits", "number_mismatch", "1"), (1, "digits", "number_mismatch", "77"), (1, "lost", "ref_outside_context", "[7]"), (1, "bare", "ref_outside_context", "no source"),
        (2, "null", "quote_mismatch", "mười chữ cái ở đây"), (2, "none", "ref_outside_context", "no source"), (3, "", "ref_outside_context", "[1]"),
    ])
    assert vf.verify(*[f.limit(0) for f in frames]).count() == 0


def test_windows_that_cannot_reach_are_left_out_before_letters_are_summed(monkeypatch):
    import random

    from chronofold.operators import verify as vf

    rnd, summed, exact = random.Random(4), [], vf._bounds
    monkeypatch.setattr(vf, "_bounds", lambda q, t, starts, size: summed.append(len(starts)) or exact(q, t, starts, size))
    for k in range(300):
        text = "".join(rnd.choice("abcdeé ghij") for _ in range(rnd.randrange(30, 400)))
        at = rnd.randrange(len(text) - 20)
        quote = "".join(rnd.choice("xyz") if rnd.random() < 0.04 else c for c in text[at : at + rnd.randrange(11, 60)])
        full, bound = vf.best_ratio(quote, text), vf.best_ratio(quote, text, vf.FUZZY)
        assert bound == full if full >= vf.FUZZY else bound < vf.FUZZY, (quote, text)
    summed.clear()
    assert vf.best_ratio("w" * 40, "abc " * 500, vf.FUZZY) == 0.0 and not summed
