"""The desk's lists and boards, ingestion decisions, sequence checks and merges of extracted operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def due_ops(pending: DataFrame, ops: DataFrame, today: Column) -> DataFrame:
    """pending(node_id, ...) with the number of proposed operators of each node that are due."""
    due = ops.filter((F.col("status") == "proposed") & (F.col("valid_from") <= today)).groupBy("node_id").agg(F.count("*").alias("due"))
    return pending.join(due, "node_id", "left").withColumn("due", F.coalesce("due", F.lit(0)))


def batch_counts(batches: DataFrame, ops: DataFrame) -> DataFrame:
    """batches(batch_id, ...) with the number of their operators, none included."""
    n = ops.groupBy("batch_id").agg(F.count("*").alias("ops_count"))
    return batches.join(n, "batch_id", "left").withColumn("ops_count", F.coalesce("ops_count", F.lit(0)))


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without node, norm and frontier, with their source's address."""
    open_ = edges.filter("dst_node is null and dst_norm is null and frontier_ref is null")
    return open_.join(nodes.select(F.col("node_id").alias("src_node"), "path", "doc_key"), "src_node")


def visible_edges(edges: DataFrame, nodes: DataFrame, audiences: list[str]) -> DataFrame:
    """Edges whose ends are visible; an end outside the corpus (null) hides nothing."""
    seen = nodes.filter(F.col("audience").isin(audiences)).select("node_id")
    out = edges.join(seen.withColumnRenamed("node_id", "src"), "src", "left_semi")
    inside = out.filter("dst is not null").join(seen.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return inside.unionByName(out.filter("dst is null"))


def provenance(ops: DataFrame, sources: DataFrame, batches: DataFrame, audiences: list[str]) -> DataFrame:
    """Operators from visible sources with the person who signed their batch."""
    seen = sources.filter(F.col("audience").isin(audiences)).select("source_artifact", "doc_key")
    return ops.join(seen, "source_artifact").join(batches, "batch_id", "left")


#: The note that a second extractor's operator hands on, and the flag of dates that differ.
ON_AMENDMENT, DATE_FLAG = "target_is_amending_provision", "date_mismatch_rule_vs_llm"


def merge_extractions(rules: DataFrame, others: DataFrame, enabled: bool = True) -> DataFrame:
    """Operators of two extractors, once for each (doc_id, kind, target, part), the target being the path or else the
    printed address in lower case. Both have doc_id, seq, kind, path, surface, part, new_text, valid_from,
    valid_to_event, scope, confidence, extractor and notes.

    A rule's operator keeps its text and date, even none; of several the last counts. Where the second extractor has it
    too, they agree: the higher confidence, both names, what the rule lacks of valid_to_event and scope, the note
    that the target is an amendment, and a flag for each date that differs. Operators of the second alone are its first,
    with the highest confidence among repeats. With the second switched off nothing agrees."""
    target = F.coalesce(F.nullif("path", F.lit("")), F.lower("surface"), F.lit(""))
    keys = ["doc_id", "k", "t", "p"]
    fields = ["seq", "kind", "path", "surface", "part", "new_text", "valid_from", "valid_to_event", "scope", "confidence", "extractor", "notes"]
    row = F.struct(*fields)
    keyed = lambda df: df.withColumn("k", F.coalesce("kind", F.lit(""))).withColumn("t", target).withColumn("p", F.coalesce("part", F.lit("")))
    r = keyed(rules).groupBy(*keys).agg(F.max_by(row, "seq").alias("r"))
    o = keyed(others).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("o"))
    m = r.join(o, keys, "full")
    r, o, first = F.col("r"), F.coalesce("o", F.array().cast(dict(m.dtypes)["o"])), F.get("o", F.lit(0))
    both = r.isNotNull() & F.col("o").isNotNull()
    own = lambda c: F.when(r.isNotNull(), r[c]).otherwise(first[c]).alias(c)
    # What the rule lacks comes from the first of the others that has it.
    filled = lambda c: F.coalesce(F.nullif(r[c], F.lit("")), F.get(F.filter(F.transform(o, lambda x: x[c]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), r[c])
    flags = F.transform(F.filter(o, lambda x: F.coalesce(x["valid_from"] != r["valid_from"], F.lit(False))), lambda _: F.lit(DATE_FLAG))
    late = lambda c, mine: F.when(r.isNotNull(), mine).otherwise(first[c]).alias(c)
    return m.select(
        "doc_id", *[own(c) for c in ("seq", "kind", "path", "surface", "part", "new_text", "valid_from")], late("valid_to_event", filled("valid_to_event")), late("scope", filled("scope")),
        F.greatest(r["confidence"], F.array_max(F.transform(o, lambda x: x["confidence"]))).alias("confidence"),
        late("extractor", F.concat_ws("+", r["extractor"], F.transform(o, lambda x: x["extractor"]))),
        late("notes", F.when(F.exists(o, lambda x: F.coalesce(x["notes"] == ON_AMENDMENT, F.lit(False))), ON_AMENDMENT).otherwise(r["notes"])),
        (both & F.lit(enabled)).alias("agree"), F.coalesce(flags, F.array().cast("array<string>")).alias("red_flags"),
    )


def sequence_gaps(items: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Items whose number is not the one after their predecessor's (the first: 1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = items.withColumn("expected", F.coalesce(F.lag(number).over(w) + 1, F.lit(1)))
    return out.filter(F.col(number) != F.col("expected"))


def ingest_decision(arrivals: DataFrame, held: DataFrame) -> DataFrame:
    """arrivals(doc_key, content) against held(doc_key, sha): new, same or conflict."""
    a = arrivals.withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))
    h = held.select("doc_key", F.col("sha").alias("held_sha"))
    decision = F.when(F.col("held_sha").isNull(), "new").when(F.col("held_sha") == F.col("sha"), "same").otherwise("conflict")
    return a.join(h, "doc_key", "left").select("doc_key", "sha", decision.alias("decision"))


def without_repeats(lines: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Lines that differ from the line before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return lines.withColumn("_was", F.lag(value).over(w)).filter(F.col("_was").isNull() | (F.col("_was") != F.col(value))).drop("_was")


def answer_events(answers: DataFrame) -> DataFrame:
    """answers(id, tokens, citations, banners, tier) to (id, ord, event, data): meta, tokens, citations, banners, tier, done."""
    many = lambda c, event: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(event).alias("event"), x.alias("data")))
    one = lambda event, data: F.array(F.struct(F.lit(event).alias("event"), data.cast("string").alias("data")))
    all_ = F.concat(one("meta", F.col("id")), many("tokens", "token"), many("citations", "citation"), many("banners", "banner"), one("tier", F.col("tier")), one("done", F.lit("")))
    return answers.select("id", F.posexplode(all_).alias("ord", "e")).select("id", "ord", "e.event", "e.data")


def branch_groups(versions: DataFrame) -> DataFrame:
    """Nodes with several scopes, and how many."""
    return versions.groupBy("node_id").agg(F.count_distinct("scope_hash").alias("branches")).filter("branches > 1")


def unguarded(rows: DataFrame, guards: DataFrame, key: str) -> DataFrame:
    """Keys of rows that no guard holds."""
    return rows.select(key).distinct().join(guards.select(key).distinct(), key, "left_anti")


def first_terms(terms: DataFrame, key: str, term: str, at: str) -> DataFrame:
    """Each term of a key once, at its first place."""
    return terms.groupBy(key, term).agg(F.min(at).alias(at))


def latest_heading(versions: DataFrame) -> DataFrame:
    return versions.groupBy("node_id").agg(F.max_by("heading", "version").alias("heading"))
