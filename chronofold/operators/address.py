"""Addresses to nodes: a temporal cascade over aliases and birth addresses, and names of documents to their keys.

    asks(ask_id, doc_key, path, at)      aliases(doc_key, path, node_id, valid_from, valid_to)
    nodes(node_id, doc_key, path)

Every step is an equi-join on the address and one grouping by question, so that no question's rows meet in a
nested loop; uniqueness is a count. Null addresses and dates resolve to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import path_prefixes
from .contain import containing

STEPS = ("covered", "future", "provisional")


def resolve(asks: DataFrame, aliases: DataFrame, nodes: DataFrame, ancestors: bool = False) -> DataFrame:
    """(ask_id, node_id, how, path) for every question, node_id null where nothing is found.

    covered: the alias in force at the date, the latest if several; future: the only alias that starts later;
    provisional: the only node born at the address. Several that are equally good are tied and resolve to nothing.
    Question ids are unique. ancestors: where the address itself finds nothing, not even a tie, the longest prefix that does counts; path says
    which."""
    # Each address and date is looked up once, however many ask for it. Of the aliases that start later only the last
    # start of an address can be alone; those in force are counted by their windows, not one by one.
    where = ["doc_key", "path"]
    paths = F.explode(path_prefixes(F.col("asked"))) if ancestors else F.col("asked")
    asked = asks.select("ask_id", "doc_key", "at", F.col("path").alias("asked"))
    looked = asked.select("doc_key", "at", "asked").distinct().filter("at is not null").select("doc_key", "at", "asked", paths.alias("path"))
    days = looked.select(*where, "at").distinct()
    named = aliases.select(*where, "node_id", "valid_from", "valid_to").distinct().filter("valid_from is not null")
    windows = named.groupBy(*where, "valid_from", "valid_to").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    covers = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    at_start = days.join(windows, where).filter(covers).groupBy(*where, "at", "valid_from").agg(F.sum("n").alias("n"), F.min("node_id").alias("node_id"))
    now = at_start.groupBy(*where, "at").agg(F.max_by(F.struct("n", "node_id"), "valid_from").alias("b")).select(*where, "at", F.lit(1).alias("step"), "b.*")
    starts = windows.groupBy(*where, "valid_from").agg(F.sum("n").alias("n"), F.min("node_id").alias("node_id"))
    order = Window.partitionBy(*where).orderBy("valid_from")
    last = starts.withColumn("before", F.lag("valid_from").over(order)).withColumn("next", F.lead("valid_from").over(order)).filter("next is null and n = 1")
    future = days.join(last, where).filter("at < valid_from and (before is null or before <= at)").select(*where, "at", F.lit(2).alias("step"), "n", "node_id")
    alone = nodes.select(*where, "node_id").distinct().groupBy(*where).agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).filter("n = 1")
    born = days.join(alone, where).select(*where, "at", F.lit(3).alias("step"), "n", "node_id")
    best = now.unionByName(future).unionByName(born)
    # A tie in force stops the cascade; several future aliases or births only leave their step.
    rank = F.struct((-F.length("path")).alias("short"), "step")
    found = looked.join(best, [*where, "at"]).groupBy("doc_key", "at", "asked").agg(F.min_by(F.struct("path", "step", "n", "node_id"), rank).alias("f"))
    how = F.when(F.col("f")["n"] > 1, "tied").when(F.col("f")["path"] != F.col("asked"), "ancestor").otherwise(F.element_at(F.array(*map(F.lit, STEPS)), F.col("f")["step"]))
    out = asked.join(found, ["doc_key", "at", "asked"], "left")
    return out.select("ask_id", F.when(F.col("f")["n"] == 1, F.col("f")["node_id"]).alias("node_id"), F.when(F.col("f").isNotNull(), how).alias("how"), F.col("f")["path"].alias("path"))


def find_document(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """asks(ask_id, number, issued, hint) to (ask_id, doc_key): by number alone where there is one; else the only
    document of that date; else the only one whose title holds the hint or, if longer than eight letters, stands in it.
    docs(doc_key, issued, title)."""
    keys = docs.select("doc_key").distinct()
    exact = asks.join(keys.hint("merge"), F.col("number") == F.col("doc_key")).select("ask_id", "doc_key")
    rest = asks.filter(F.coalesce("number", F.lit("")) == "")
    # A date stands for the smallest and largest of its documents' keys: its questions don't meet its documents one by one.
    days = docs.filter("doc_key is not null and issued is not null").groupBy(F.col("issued").alias("day")).agg(F.min("doc_key").alias("low"), F.max("doc_key").alias("high"))
    dated = rest.join(days, F.col("issued") == F.col("day")).groupBy("ask_id").agg(F.min("low").alias("doc_key"), F.max("high").alias("high")).filter("doc_key = high").select("ask_id", "doc_key")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    open_ = rest.join(dated, "ask_id", "left_anti").filter(plain("hint") != "")
    # Equal hints and equal titles meet once; a title stands for the smallest and largest of its documents' keys.
    open_ = open_.select("ask_id", plain("hint").alias("hint"))
    titles = docs.select("doc_key", plain("title").alias("title")).filter("title <> '' and doc_key is not null").groupBy("title").agg(F.min("doc_key").alias("low"), F.max("doc_key").alias("high"))
    hints = open_.select("hint").distinct()
    inside = containing(hints.select(F.col("hint").alias("pattern_id"), F.col("hint").alias("pattern")), titles.select(F.col("title").alias("text_id"), F.col("title").alias("text")))
    around = containing(titles.filter(F.length("title") > 8).select(F.col("title").alias("pattern_id"), F.col("title").alias("pattern")), hints.select(F.col("hint").alias("text_id"), F.col("hint").alias("text")))
    pairs = inside.select(F.col("pattern_id").alias("hint"), F.col("text_id").alias("title")).unionByName(around.select(F.col("text_id").alias("hint"), F.col("pattern_id").alias("title")))
    named = pairs.join(titles, "title").groupBy("hint").agg(F.min("low").alias("doc_key"), F.max("high").alias("high")).filter("doc_key = high")
    by_hint = open_.join(named, "hint").groupBy("ask_id").agg(F.min("doc_key").alias("doc_key"), F.max("doc_key").alias("high")).filter("doc_key = high").select("ask_id", "doc_key")
    found = exact.unionByName(dated).unionByName(by_hint)
    return asks.select("ask_id").join(found, "ask_id", "left")


def resolve_shorthand(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """asks(ask_id, number) to (ask_id, doc_key): a bare number names the only document whose key starts with it."""
    lead = lambda c: F.regexp_replace(F.substring_index(c, "/", 1), "^0+", "")
    hits = docs.select("doc_key", lead("doc_key").alias("_n")).distinct().withColumn("_many", F.count("*").over(Window.partitionBy("_n")))
    hits = hits.filter("_many = 1").select("doc_key", "_n")
    return asks.withColumn("_n", F.regexp_replace("number", "^0+", "")).join(hits, "_n", "left").select("ask_id", "doc_key")
