"""Hard checks of an answer against its context: tags, quotations and numbers.

    answers(answer_id, answer, numbers ARRAY<STRING>)      claims(answer_id, claim_id, text, refs ARRAY<STRING>)
    bases(answer_id, ref)      context(answer_id, ref, text)

Refs are looked up by joins; each quotation meets each text that its claim cites. A quotation that doesn't stand in a
text is compared with windows of it: counts of letters bound every window's ratio at once, and windows are compared
from the highest bound down only while the bound can still win, so the result is that of comparing all.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import digit_runs, quotes

# Least ratio of a quotation, and the ratio at which a search ends.
FUZZY, ENOUGH = 0.9, 0.999
TAG = r"\[([0-9]+)\]"


def _bounds(q: str, t: str, starts: np.ndarray, size: int) -> np.ndarray:
    """For each window of t, a bound on its ratio with q: the letters that both have, with how often."""
    letters = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    stops = np.minimum(starts + size, len(letters))
    shared = np.zeros(len(starts), np.int64)
    for c in set(q):
        upto = np.concatenate([[0], np.cumsum(letters == ord(c))])
        shared += np.minimum(upto[stops] - upto[starts], q.count(c))
    return 2.0 * shared / (len(q) + stops - starts)


def _possible(q: str, t: str, starts: np.ndarray, size: int, step: int, least: float) -> np.ndarray:
    """Whether each window of t can reach `least`, by the letters of the blocks of a step that cover it: one pass over
    the text for all letters. A window that can is never left out."""
    letters, own = np.frombuffer(t.encode("utf-32-le"), np.uint32), np.unique(np.frombuffer(q.encode("utf-32-le"), np.uint32))
    code = np.searchsorted(own, letters).clip(max=len(own) - 1)
    held = own[code] == letters
    blocks = len(letters) // step + 1
    counts = np.bincount((np.arange(len(letters)) // step * len(own) + code)[held], minlength=blocks * len(own)).reshape(blocks, len(own))
    upto = np.concatenate([np.zeros((1, len(own)), np.int64), np.cumsum(counts, 0)])
    stops = np.minimum(starts + size, len(letters))
    shared = np.minimum(upto[np.minimum(-(-stops // step), blocks)] - upto[starts // step], [q.count(chr(c)) for c in own]).sum(1)
    return 2.0 * shared / (len(q) + stops - starts) >= least


def best_ratio(quote: str | None, text: str | None, least: float = 0.0) -> float:
    """1 if the quotation stands in the text whatever the case and blanks; else the best ratio of it with windows of its
    length and a step more, a step being a fifth of it and ten letters at least. 0 if either is empty. Windows that can't
    reach `least` are left out: a result below it then only says that none does."""
    q, t = (" ".join((s or "").split()) for s in (quote, text))
    if not q or not t:
        return 0.0
    low = q.lower()
    if low in t.lower():
        return 1.0
    ratio = lambda w: SequenceMatcher(None, low, w.lower()).ratio()
    if len(t) <= len(q):
        return ratio(t)
    step = max(10, len(q) // 5)
    starts = np.arange(0, len(t) - len(q) + 1, step)
    # Lower case can change a text's length, so windows are cut first; then bounds hold for texts that keep theirs.
    if len(t.lower()) != len(t) or len(low) != len(q):
        bounds = np.ones(len(starts))
    else:
        starts = starts[_possible(low, t.lower(), starts, len(q) + step, step, least)]
        bounds = _bounds(low, t.lower(), starts, len(q) + step) if len(starts) else np.zeros(0)
    for s in starts[bounds >= ENOUGH].tolist():
        if (r := ratio(t[s : s + len(q) + step])) >= ENOUGH:
            return r
    best = 0.0
    for k in np.argsort(-bounds, kind="stable").tolist():
        if bounds[k] <= best or bounds[k] < least:
            break
        best = max(best, ratio(t[starts[k] : starts[k] + len(q) + step]))
    return best


@F.pandas_udf(DoubleType())
def fuzzy_ratio(quote: pd.Series, text: pd.Series) -> pd.Series:
    """best_ratio of each row."""
    return pd.Series([best_ratio(q, t) for q, t in zip(quote, text)], dtype="float64")


@F.pandas_udf(DoubleType())
def _reached(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_ratio(q, t, FUZZY) for q, t in zip(quote, text)], dtype="float64")


def _similar(quote: Column, text: Column) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.when((plain(quote) != "") & F.contains(plain(text), plain(quote)), 1.0).otherwise(_reached(quote, text))


def verify(answers: DataFrame, claims: DataFrame, bases: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, claim_id, kind, detail), one row per failure; an answer without rows passes.

    ref_outside_context: a tag, a claim's or a basis's ref that the context lacks, or a claim without refs.
    quote_mismatch: a quotation of ten letters or more that is like no text its claim cites, or, in the answer outside
    all claims, unlike the whole context. number_mismatch: a claim's number, tags aside, that stands neither in its cited
    texts nor in the question. Null texts hold nothing; a missing list is empty."""
    none, refs = F.array().cast("array<string>"), context.select("answer_id", "ref").distinct()
    claims = claims.withColumn("refs", F.coalesce("refs", none))
    fail = lambda df, kind, claim="claim_id", detail="detail": df.select("answer_id", (F.col(claim) if isinstance(claim, str) else claim).cast("string").alias("claim_id"), F.lit(kind).alias("kind"), F.col(detail).alias("detail"))
    nobody = F.lit(None)
    tags = answers.select("answer_id", F.explode(F.regexp_extract_all("answer", F.lit(TAG), F.lit(0))).alias("ref"))
    cited = claims.select("answer_id", "claim_id", F.explode("refs").alias("ref"))
    out = fail(tags.join(refs, ["answer_id", "ref"], "left_anti"), "ref_outside_context", nobody, "ref")
    out = out.unionByName(fail(cited.join(refs, ["answer_id", "ref"], "left_anti"), "ref_outside_context", detail="ref"))
    out = out.unionByName(fail(bases.join(refs, ["answer_id", "ref"], "left_anti"), "ref_outside_context", nobody, "ref"))
    out = out.unionByName(fail(claims.filter(F.size("refs") == 0).withColumn("detail", F.lit("no source")), "ref_outside_context"))

    said = claims.select("answer_id", "claim_id", F.posexplode(quotes(F.coalesce("text", F.lit("")))).alias("at", "quote"))
    shown = cited.join(context, ["answer_id", "ref"])
    near = said.join(shown.select("answer_id", "claim_id", F.col("text").alias("source")), ["answer_id", "claim_id"], "left")
    near = near.groupBy("answer_id", "claim_id", "at", "quote").agg(F.max(_similar(F.col("quote"), F.coalesce("source", F.lit("")))).alias("r"))
    out = out.unionByName(fail(near.filter(F.col("r") < FUZZY), "quote_mismatch", detail="quote"))

    runs = shown.select("answer_id", "claim_id", F.explode(digit_runs(F.coalesce("text", F.lit("")))).alias("run"))
    asked = answers.select("answer_id", F.explode("numbers").alias("run"))
    numbers = claims.select("answer_id", "claim_id", F.explode(digit_runs(F.regexp_replace(F.coalesce("text", F.lit("")), TAG, " "))).alias("run"))
    loose = numbers.join(runs, ["answer_id", "claim_id", "run"], "left_anti").join(asked, ["answer_id", "run"], "left_anti")
    out = out.unionByName(fail(loose, "number_mismatch", detail="run"))

    bare = answers.select("answer_id", F.posexplode(quotes(F.coalesce("answer", F.lit("")))).alias("at", "quote"))
    bare = bare.join(said.select("answer_id", "quote").distinct(), ["answer_id", "quote"], "left_anti")
    whole = context.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("source"))
    bare = bare.join(whole, "answer_id", "left").withColumn("r", _similar(F.col("quote"), F.coalesce("source", F.lit(""))))
    return out.unionByName(fail(bare.filter(F.col("r") < FUZZY), "quote_mismatch", nobody, "quote"))
