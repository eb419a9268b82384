"""Amendments read from a document's clauses, and phrase replacements worked out on the texts they reach.

    clauses(doc_id, path, text, effective)      bodies(node_id, body)

Directives are anchored patterns outside quotations; the printed addresses after them become targets, one operator each,
and a quoted block is split into units that are dealt to the targets by their labels. Everything up to the operators is
columns of one clause; replacements are folded over a node's operators in their order, so that each one meets the
text as amended so far. Null texts give nothing. A clause's directives, and a node's operators, are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.legal import parse_date, unquote
from ..functions.quotes import _places, let, quote_block, quoted_spans, quoted_units
from ..functions.surface import references, sentence_at
from ..sources.scratch import stage

# How directives are printed, by kind; the first group is what they reach.
DIRECTIVES = (
    ("phrase", r"(?U)[Tt]hay thế cụm từ\s+[“\"][^”\"]+[”\"]\s+bằng\s+(?:cụm từ\s+)?[“\"][^”\"]+[”\"](?:\s+tại\s+([^.;\n]{2,220}))?"),
    ("suspend", r"(?iuU)Ngưng hiệu lực thi hành\s+([^;\n]{2,400})"),
    ("insert", r"(?iuU)(?<!đổi, )Bổ sung\s+([^:“\n]{2,200}?)\s*(?:như sau\s*:|:\s*$|:\s*(?=“))"),
    ("amend", r"(?iuU)(?:Sửa đổi, bổ sung|Sửa đổi)\s+(?:tên\s+)?(?!.{0,30}vào\s)([^:“\n]{2,300}?)\s*(?:như sau\s*:|(?=\s*\n\s*“))"),
    ("repeal", r"(?iuU)Bãi bỏ\s+([^.;“\n]{2,220})"),
)
PHRASES = r"(?U)cụm từ\s+[“\"]([^”\"]+)[”\"]\s+bằng\s+(?:cụm từ\s+)?[“\"]([^”\"]+)[”\"]"
FROM = r"(?U)(?:kể\s+)?từ\s+ngày\s+([^,;.]{4,60})"
UNTIL = r"(?iuU)(?:cho\s+)?đến\s+(?:hết\s+)?ngày\s+([^;.]{2,240}?)(?=\s+đối với\b|\s*[;.]|$)"
EVENT = r"(?iu)có hiệu lực|văn bản|ban hành"
NO_TARGET, NO_UNIT, NOT_FOUND = "no_target_list", "unit_missing", "phrase_not_found_in_target"


def validity(sentence: Column, effective: Column) -> Column:
    """(valid_from, valid_to, valid_to_event) that a sentence states: from a date or else the document's, and to a date
    or an event that has none yet."""
    dated = lambda form: parse_date(F.concat(F.lit("ngày "), F.regexp_extract(sentence, form, 1)))
    until = F.trim(F.regexp_extract(sentence, UNTIL, 1))
    event = F.when(dated(UNTIL).isNull() & until.rlike(EVENT), F.concat(F.lit("đến ngày "), until))
    return F.struct(F.coalesce(dated(FROM), effective).alias("valid_from"), dated(UNTIL).alias("valid_to"), event.alias("valid_to_event"))


def directives(clauses: DataFrame) -> DataFrame:
    """(doc_id, path, kind, at, mark, reach, sentence, block): every directive of a clause outside quotations. One that
    starts inside another one before it in the list of kinds is part of that."""
    return _directives(clauses, "doc_id", "path", "effective")


def _directives(clauses: DataFrame, *columns: str) -> DataFrame:
    """The same with these columns of the clauses."""
    def found(rank: int, kind: str, form: str) -> Column:
        return F.transform(_places(F.col("text"), form), lambda p: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["at"].alias("at"), p["mark"].alias("mark"), F.regexp_extract(F.substring(F.col("text"), p["at"] + 1, F.length(F.col("text"))), form, 1).alias("reach")))

    every = F.flatten(F.array(*[found(rank, kind, form) for rank, (kind, form) in enumerate(DIRECTIVES)]))
    quoted = lambda x, spans: F.exists(spans, lambda s: (s["start"] <= x["at"]) & (x["at"] < s["stop"]))
    loose = let(quoted_spans(F.col("text")), lambda spans: F.filter(every, lambda x: ~quoted(x, spans)))
    inside = lambda x, all_: F.exists(all_, lambda y: (y["rank"] < x["rank"]) & (y["at"] <= x["at"]) & (x["at"] < y["at"] + F.length(y["mark"])))
    own = let(loose, lambda all_: F.filter(all_, lambda x: ~inside(x, all_)))
    # Outer: what an inner explode is of would be worked out again to drop the rows without any.
    rows = clauses.select(*clauses.columns, F.explode_outer(own).alias("x")).filter("x is not null")
    block = F.when(F.col("x.kind").isin("insert", "amend"), quote_block(F.col("text"), F.col("x.at") + F.length("x.mark") - 1)["block"])
    return rows.select(*columns, "x.kind", "x.at", "x.mark", "x.reach", sentence_at(F.col("text"), F.col("x.at")).alias("sentence"), block.alias("block"))


def operators(clauses: DataFrame) -> DataFrame:
    """(doc_id, source_path, seq, kind, target_path, document, new_text, phrase_from, phrase_to, valid_from, valid_to,
    valid_to_event, confidence, red_flags): the operators that the clauses order.

    A replacement of phrases amends each unit it names; without any it is one flagged operator. Insertions and amendments
    take the quoted unit with their target's label, a sole target the whole block; a target without its unit is
    flagged. Directives of other kinds without a target order nothing here."""
    # Equal texts are read once, and their operators joined to the clauses: texts are far slower to read than to compare.
    rows = _directives(clauses.select("text").filter("text is not null").distinct(), "text")
    rows = rows.withColumn("_groups", references(F.col("reach")))
    targets = F.flatten(F.transform("_groups", lambda g: F.transform(g["paths"], lambda p: F.struct(p.alias("path"), g["document"].alias("document")))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("document")))
    rows = rows.withColumn("_targets", F.when((F.col("kind") == "phrase") & (F.size(F.coalesce(targets, F.array().cast("array<struct<path:string,document:string>>"))) == 0), none).otherwise(targets))
    rows = rows.withColumn("_n", F.size("_targets")).withColumn("_units", quoted_units(F.col("block"))).select("*", F.posexplode_outer("_targets").alias("_i", "t")).filter("_i is not null")
    last = F.substring_index("t.path", "/", -1)
    unit = F.get(F.filter("_units", lambda u: F.concat(u["level"], F.lit(":"), u["label"]) == last), F.lit(0))["text"]
    text = F.when(F.col("block").isNotNull(), F.coalesce(unit, F.when(F.col("_n") == 1, unquote(F.col("block")))))
    flag = F.when(F.col("t.path").isNull(), NO_TARGET).when(F.col("kind").isin("insert", "amend") & text.isNull(), NO_UNIT)
    phrase = lambda k: F.when(F.col("kind") == "phrase", F.regexp_extract("mark", PHRASES, k))
    entry = F.struct(
        "at", "_i", F.when(F.col("kind") == "phrase", "amend").otherwise(F.col("kind")).alias("kind"), F.col("t.path").alias("target_path"), F.col("t.document").alias("document"), text.alias("new_text"),
        phrase(1).alias("phrase_from"), phrase(2).alias("phrase_to"), "_v.valid_from", "_v.valid_to", "_v.valid_to_event",
        F.when(flag.isNotNull(), 0.3).otherwise(0.85).alias("confidence"), F.when(flag.isNotNull(), F.array(flag)).otherwise(F.array().cast("array<string>")).alias("red_flags"),
    )
    # The document's own date comes in where the sentence has none: it is the clause's, not the text's.
    made = rows.withColumn("_v", validity(F.col("sentence"), F.lit(None).cast("date"))).select("text", entry.alias("o"))
    read = stage(made.groupBy("text").agg(F.collect_list("o").alias("_ops")))
    # Left: the clauses stay where they are, whichever side is smaller, if the texts read are few enough to be sent to them.
    ordered = clauses.select("doc_id", "path", "effective", "text").join(read, "text", "left").select("doc_id", "path", "effective", F.explode_outer("_ops").alias("o")).filter("o is not null")
    w = Window.partitionBy("doc_id").orderBy("path", "o.at", "o._i")
    return ordered.select(
        "doc_id", F.col("path").alias("source_path"), F.row_number().over(w).alias("seq"), "o.kind", "o.target_path", "o.document", "o.new_text", "o.phrase_from", "o.phrase_to",
        F.coalesce("o.valid_from", "effective").alias("valid_from"), "o.valid_to", "o.valid_to_event", "o.confidence", "o.red_flags",
    )


def materialise(ops: DataFrame, bodies: DataFrame) -> DataFrame:
    """ops(op_id, node_id, seq, phrase_from, phrase_to) with old_text, new_text, and whether the phrase was there: each
    replacement is applied to its node's text as the ones before it left it. One whose phrase is missing changes
    nothing. An unknown node has an empty text."""
    entry = F.struct("seq", "op_id", F.coalesce("phrase_from", F.lit("")).alias("a"), F.coalesce("phrase_to", F.lit("")).alias("b"))
    nodes = ops.groupBy("node_id").agg(F.array_sort(F.collect_list(entry)).alias("ops")).join(bodies, "node_id", "left")
    start = F.struct(F.coalesce("body", F.lit("")).alias("text"), F.transform(F.slice("ops", 1, 0), lambda x: F.struct(x["op_id"].alias("op_id"), F.lit("").alias("old_text"), F.lit("").alias("new_text"), F.lit(True).alias("found"))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        found = (x["a"] != "") & F.contains(acc["text"], x["a"])
        text = F.when(found, F.replace(acc["text"], x["a"], x["b"])).otherwise(acc["text"])
        return F.struct(text.alias("text"), F.concat(acc["out"], F.array(F.struct(x["op_id"].alias("op_id"), acc["text"].alias("old_text"), text.alias("new_text"), found.alias("found")))).alias("out"))

    return nodes.select("node_id", F.explode(F.aggregate("ops", start, step)["out"]).alias("o")).select("node_id", "o.*")
