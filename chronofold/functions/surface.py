"""Printed addresses in a text: a tokenizer of unit lists, and a small grammar that joins them into paths.

"các điểm a, b và đ khoản 1, khoản 2 Điều 39 Thông tư số 39/2016/TT-NHNN" is one group: the lists' labels expand, a
higher unit closes every chain that still waits for one, and what follows binds the group to a document, to "this"
document or to the unit at hand. Everything is columns: patterns find the tokens, array folds join them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .legal import NUMBER_FORMS
from .quotes import _places, let

# Units by rank, their printed names, labels and lists, connectives, and names of documents.
RANKS = {"tiet": 0, "diem": 1, "khoan": 2, "dieu": 3, "phuluc": 3}
NAMES = {"điều": "dieu", "khoản": "khoan", "điểm": "diem", "tiết": "tiet"}
_STOP = "(?![a-zà-ỹđ0-9])"
_PLAIN = rf"[0-9]+[a-zđ]?[0-9]?{_STOP}|[a-zđ][0-9]?(?:\s*\([ivx]+\))?{_STOP}|\([ivx]+\)"
_MORE = rf"(?:{_PLAIN})(?=[\s,;.)]|$)"
ITEM = rf"(?U)(?:các\s+)?(Điều|điều|[Kk]hoản|[Đđ]iểm|[Tt]iết|Phụ\s*lục)\s+((?:số\s+)?{_PLAIN})((?:\s*[,;]\s*(?:và\s+|hoặc\s+)?{_MORE}|\s*,?\s+(?:và|hoặc)\s+{_MORE})*)"
BETWEEN = r"(?U)\s*[,;]\s*|\s+(?:và|hoặc)\s+|^(?:và|hoặc)\s+"
LABEL = r"^(?:[0-9]+[a-zđ]?[0-9]?|[a-zđ][0-9]?|[ivx]+|[a-zđ]\([ivx]+\))$"
MIXED = r"(?U)^([a-zđ])\s*\(([ivx]+)\)$"
LINK = r"(?U)^[\s,;]*(?:và|hoặc|của|cùng|tại|thuộc)?[\s,;]*$"
KINDS = "(?:Thông tư|Nghị định|Luật|Bộ luật|Quyết định|Nghị quyết|Quy trình|Quy định|Chính sách|Văn bản)"
_NUMBER = "|".join(NUMBER_FORMS)
DOCUMENT = rf"(?iuU)^({KINDS}(?:\s+liên tịch)?[^,;.()\n]{{0,80}}?(?:số\s+(?:{_NUMBER})|(?:{_NUMBER})|ngày\s+\d{{1,2}}\s+tháng\s+\d{{1,2}}\s+năm\s+\d{{4}}|ngày\s+\d{{1,2}}/\d{{1,2}}/\d{{4}}|năm\s+(?:19|20)\d{{2}}))"
THIS = rf"(?iuU)^({KINDS}\s+này)"
RELATIVE = r"(?U)^((Điều|[Kk]hoản|[Đđ]iểm)\s+này)"
#: Longest text between two items of a group, and the text after a group that is looked at.
GAP, AFTER = 30, 200


def level_of(keyword: Column) -> Column:
    """The unit that a printed keyword names."""
    k = F.lower(keyword)
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.when(F.startswith(k, F.lit("phụ")), F.lit("phuluc")).otherwise(names[k])


def label_of(printed: Column) -> Column:
    """A label without "số" and brackets; a(iii) keeps its own."""
    s = F.regexp_replace(F.lower(F.trim(printed)), r"(?U)^số\s*", "")
    mixed = F.concat(F.regexp_extract(s, MIXED, 1), F.lit("("), F.regexp_extract(s, MIXED, 2), F.lit(")"))
    return F.when(s.rlike(MIXED), mixed).otherwise(F.regexp_replace(s, r"^[()]+|[()]+$", ""))


def list_items(mark: Column) -> Column:
    """(level, label) of each entry of one unit list; a(iii) is the item iii, then its point a."""
    part = lambda k: F.regexp_extract(mark, ITEM, k)
    pair = lambda a, b: F.struct(a.alias("level"), b.alias("label"))

    def entries(p: Column) -> Column:
        split = lambda x: F.array(pair(F.lit("tiet"), F.regexp_extract(x, MIXED, 2)), pair(F.lit("diem"), F.regexp_extract(x, MIXED, 1)))
        return F.flatten(F.transform(p["labels"], lambda x: F.when(p["level"].isin("tiet", "diem") & x.rlike(MIXED), split(x)).otherwise(F.array(pair(p["level"], x)))))

    rest = F.transform(F.split(F.trim(part(3)), BETWEEN), lambda x: F.regexp_replace(F.trim(x), r"^\)+|\)+$", ""))
    labels = F.concat(F.array(label_of(part(2))), F.transform(F.filter(rest, lambda x: x.rlike(LABEL)), label_of))
    return let(F.struct(level_of(F.regexp_replace(part(1), r"(?U)\s+", " ")).alias("level"), labels.alias("labels")), entries)


def joined_paths(items: Column) -> Column:
    """Paths of a group's entries: an entry extends every chain whose last unit is below it, or starts a chain."""
    ranks = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    zero = F.array().cast("array<struct<rank:int,path:string>>")

    def step(chains: Column, x: Column) -> Column:
        rank, own = ranks[x["level"]], F.concat(x["level"], F.lit(":"), x["label"])
        waits = lambda c: c["rank"] < rank
        up = F.transform(chains, lambda c: F.struct(F.when(waits(c), rank).otherwise(c["rank"]).alias("rank"), F.when(waits(c), F.concat(own, F.lit("/"), c["path"])).otherwise(c["path"]).alias("path")))
        return F.when(F.exists(chains, waits), up).otherwise(F.concat(chains, F.array(F.struct(rank.alias("rank"), own.alias("path")))))

    return F.array_distinct(F.transform(F.aggregate(items, zero, step), lambda c: c["path"]))


def _binding(text: Column, stop: Column) -> Column:
    """What follows a group that ends at `stop`: (document, this, relative, stop)."""

    def after(tail: Column) -> Column:
        bare = F.regexp_replace(tail, r"(?U)^\s+", "")
        return let(F.struct(bare.alias("bare"), (F.length(tail) - F.length(bare)).alias("blanks")), bind)

    def bind(t: Column) -> Column:
        of = F.startswith(t["bare"], F.lit("của "))
        rests = F.array(t["bare"], F.when(of, F.substring(t["bare"], F.lit(5), F.lit(AFTER))).otherwise(""))
        # Every form at every start, the document first: the first that is there counts.
        tried = F.flatten(F.transform(rests, lambda r, i: F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract(r, form, 1).alias("found"), (i * 4).alias("lead")) for kind, form in (("document", DOCUMENT), ("this", THIS), ("relative", RELATIVE))])))
        first = F.get(F.filter(tried, lambda x: x["found"] != ""), F.lit(0))
        return let(first, lambda m: F.struct(
            F.when(m["kind"] == "document", F.trim(m["found"])).alias("document"), F.coalesce(m["kind"] == "this", F.lit(False)).alias("this"),
            F.when(m["kind"] == "relative", level_of(F.regexp_extract(m["found"], RELATIVE, 2))).alias("relative"),
            (stop + F.coalesce(t["blanks"] + m["lead"] + F.length(m["found"]), F.lit(0))).cast("int").alias("stop"),
        ))

    return let(F.substring(text, stop + 1, F.lit(AFTER)), after)


def references(text: Column) -> Column:
    """Groups of addresses in a text, in order: (paths, document, this, relative, start, stop, raw). A list that starts
    inside the binding of the group before it is part of that. Null text, null; no address, no group."""
    tokens = F.transform(_places(text, ITEM), lambda p: F.struct(p["at"].alias("at"), (p["at"] + F.length(p["mark"])).alias("stop"), list_items(p["mark"]).alias("items"), _binding(text, p["at"] + F.length(p["mark"])).alias("bound")))
    group = "struct<start:int,stop:int,items:array<struct<level:string,label:string>>,bound:struct<document:string,this:boolean,relative:string,stop:int>>"
    zero = F.array().cast(f"array<{group}>")

    def step(groups: Column, t: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        gap = t["at"] - last["stop"]
        linked = last.isNotNull() & (gap >= 0) & (gap <= GAP) & F.substring(text, last["stop"] + 1, gap).rlike(LINK)
        made = lambda start, items: F.array(F.struct(start.alias("start"), t["stop"].alias("stop"), items.alias("items"), t["bound"].alias("bound")))
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), made(last["start"], F.concat(last["items"], t["items"])))
        # Whether a list continues the group comes first; else it must start after the group's binding.
        return F.when(linked, grown).when(last.isNull() | (t["at"] >= last["bound"]["stop"]), F.concat(groups, made(t["at"], t["items"]))).otherwise(groups)

    def shown(g: Column) -> Column:
        b = g["bound"]
        raw = F.trim(F.substring(text, g["start"] + 1, b["stop"] - g["start"]))
        return F.struct(joined_paths(g["items"]).alias("paths"), b["document"].alias("document"), b["this"].alias("this"), b["relative"].alias("relative"), g["start"].alias("start"), b["stop"].alias("stop"), raw.alias("raw"))

    return F.transform(F.aggregate(tokens, zero, step), shown)


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence around a place: after the last line end or full stop before it, up to the next semicolon or line
    end."""
    head, tail = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    before = F.regexp_extract(head, r"(?s)(?:.*(?:\n|\.(?= ))|^)(.*)$", 1)
    return F.regexp_replace(F.concat(before, F.regexp_extract(tail, r"^([^;\n]*)", 1)), r"(?U)^\s+|\s+$", "")
