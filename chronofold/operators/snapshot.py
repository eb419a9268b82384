"""Queries on a snapshot of versions: one candidate predicate, pending, timeline, status and their helpers.

    versions(run_id?, node_id, version, status, valid_from, valid_to, retrievable?, ...)
    nodes(node_id, doc_key, path)      artifacts(doc_key, audience, ...)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.temporal import valid_at

# What each role may read.
ENTITLEMENTS = {"customer": ("public",), "employee": ("public", "internal"), "curator": ("public", "internal", "restricted")}


def entitlements_for(role: str) -> tuple[str, ...]:
    if role not in ENTITLEMENTS:
        raise ValueError(f"unknown role: {role}")
    return ENTITLEMENTS[role]


def visible(role: str, audience: str | Column = "audience") -> Column:
    """Row-level gate; a null audience is hidden."""
    a = F.col(audience) if isinstance(audience, str) else audience
    return F.coalesce(a.isin(*entitlements_for(role)), F.lit(False))


def leaks(df: DataFrame, role: str) -> DataFrame:
    """Rows outside the role's entitlements; empty unless a gate is missing."""
    return df.filter(~visible(role))


def addressed(versions: DataFrame, nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    return versions.join(nodes, "node_id").join(artifacts, "doc_key")


def candidates(rows: DataFrame, as_of: str, role: str, applies: Column | None = None) -> DataFrame:
    """The one predicate: active, valid, visible and possibly applicable, in address order."""
    keep = (F.col("status") == "active") & valid_at(as_of) & visible(role)
    rows = rows.filter(keep if applies is None else keep & applies)
    return rows.orderBy("doc_key", "path", "version")


def pending(rows: DataFrame, as_of: str, role: str) -> DataFrame:
    return rows.filter((F.col("status") == "active") & (F.col("valid_from") > F.lit(as_of).cast("date")) & visible(role))


def timeline(rows: DataFrame, aliases: DataFrame, doc_key: str, path: str) -> DataFrame:
    """All versions at an address: of nodes that an alias names, and of nodes born there; two semi-joins, no OR join."""
    named = aliases.filter((F.col("doc_key") == doc_key) & (F.col("path") == path)).select("node_id").distinct()
    in_doc = rows.filter(F.col("doc_key") == doc_key)
    return in_doc.join(named, "node_id", "left_semi").unionByName(in_doc.filter(F.col("path") == path)).distinct()


def status_at(versions: DataFrame, as_of: str) -> DataFrame:
    """One status per node at a date, active before others."""
    order = F.struct((F.col("status") != "active").cast("int"), "status")
    return versions.filter(valid_at(as_of)).groupBy("node_id").agg(F.min_by("status", order).alias("status"))


def suspensions(versions: DataFrame, as_of: str, open_events: DataFrame) -> DataFrame:
    """Suspended versions at a date, and whether an open event holds one of their operators (provenance array)."""
    rows = versions.filter(valid_at(as_of) & (F.col("status") == "suspended"))
    held = rows.select("node_id", "version", F.explode("provenance").alias("op_id")).join(open_events.select("op_id").distinct(), "op_id", "left_semi")
    return rows.join(held.select("node_id", "version").distinct().withColumn("_open", F.lit(True)), ["node_id", "version"], "left").withColumn("open_event", F.coalesce("_open", F.lit(False))).drop("_open")


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end in nodes(node_id)."""
    ids = nodes.select("node_id").distinct()
    a = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    b = edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return a.unionByName(b).distinct()


def latest_run(runs: DataFrame, known_at: str | None = None) -> DataFrame:
    """(run_id): newest run by cutoff, at or before a time."""
    seen = runs if known_at is None else runs.filter(F.col("k_cutoff") <= F.lit(known_at).cast("timestamp_ntz"))
    return seen.agg(F.max_by("run_id", "k_cutoff").alias("run_id"))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order (DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_changes(versions: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether each version's value differs from the one before it, and whether its key is never active."""
    w = Window.partitionBy(*keys).orderBy("valid_from", "version")
    n = F.row_number().over(w)
    changed = (n > 1) & ~F.lag(value).over(w).eqNullSafe(F.col(value))
    ever = F.max((F.col("status") == "active").cast("int")).over(Window.partitionBy(*keys)) == 1
    return versions.withColumn("changed", changed).withColumn("never_active", (F.col("status") == "suspended") & ~ever)


def coverage(channels: DataFrame, ttl: dict[str, int], default_days: int = 14) -> DataFrame:
    """channels(channel, last_seq, last_checked) folded to the newest check, with each channel's horizon."""
    days = F.coalesce(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv])[F.col("channel")], F.lit(default_days))
    newest = channels.groupBy("channel").agg(F.max_by("last_seq", "last_checked").alias("last_seq"), F.max("last_checked").alias("last_checked"))
    return newest.withColumn("horizon", F.date_add("last_checked", days))


def oracle_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, verdict) where two path -> text tables differ after white-space normalisation."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    a = ours.select("path", clean(F.col("text")).alias("_a"))
    b = theirs.select("path", clean(F.col("text")).alias("_b"))
    verdict = F.when(F.col("_a").isNull(), "missing_in_snapshot").when(F.col("_b").isNull(), "missing_in_oracle").when(F.col("_a") != F.col("_b"), "text_mismatch")
    return a.join(b, "path", "full").withColumn("verdict", verdict).filter("verdict is not null").select("path", "verdict")
