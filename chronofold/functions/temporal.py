"""Half-open validity: predicates, SCD-2 windows, coalescing and tiling checks as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_at(t: Column | str, start: str = "valid_from", end: str = "valid_to") -> Column:
    """start <= t < end; a null end is open."""
    t = F.lit(t).cast("date") if isinstance(t, str) else t
    return (F.col(start) <= t) & (F.col(end).isNull() | (t < F.col(end)))


def min_end(a: Column, b: Column) -> Column:
    """The earlier of two window ends; null is open."""
    return F.least(a, b)


def scd2(df: DataFrame, keys: list[str], start: str = "valid_from", order: list[str] | None = None, end: str = "valid_to") -> DataFrame:
    """Each row's window ends where the next row of its key starts."""
    w = Window.partitionBy(*keys).orderBy(start, *(order or []))
    return df.withColumn(end, F.lead(start).over(w))


def close_aliases(df: DataFrame, keys: list[str], value: str, start: str = "valid_from") -> DataFrame:
    """SCD-2 of an address book: repeats of the value that is open are no change."""
    w = Window.partitionBy(*keys).orderBy(start, value)
    changed = df.dropDuplicates([*keys, value, start]).withColumn("_was", F.lag(value).over(w))
    changed = changed.filter(F.col("_was").isNull() | (F.col("_was") != F.col(value))).drop("_was")
    return scd2(changed, keys, start, [value])


def coalesce_intervals(df: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Maximal intervals of each key: overlapping and touching ones merge, an open end absorbs what follows."""
    w = Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max(F.col(end).isNull().cast("int")).over(before)
    reach = F.max(end).over(before)
    fresh = F.when(opened == 1, 0).when(reach >= F.col(start), 0).otherwise(1)
    marked = df.withColumn("_new", F.coalesce(fresh, F.lit(1)))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.when(F.max(F.col(end).isNull().cast("int")) == 1, None).otherwise(F.max(end))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), last.alias(end)).drop("_island")


def tiling_problems(versions: DataFrame, node: str = "node_id", scope: str = "scope_hash", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(node, problem, at): empty windows, successors of a scope that don't start at their predecessor's end,
    and gaps in the union of a node's branches."""
    empty = versions.filter(F.col(end) <= F.col(start)).select(node, F.lit("empty").alias("problem"), F.col(start).alias("at"))
    w = Window.partitionBy(node, scope).orderBy(start, F.col(end).asc_nulls_last())
    broken = versions.withColumn("_end", F.lag(end).over(w)).withColumn("_n", F.row_number().over(w))
    broken = broken.filter((F.col("_n") > 1) & (F.col("_end").isNull() | (F.col("_end") != F.col(start)))).select(node, F.lit("broken").alias("problem"), F.col(start).alias("at"))
    islands = coalesce_intervals(versions.select(node, start, end), [node], start, end)
    first = Window.partitionBy(node).orderBy(start)
    gaps = islands.withColumn("_n", F.row_number().over(first)).filter("_n > 1").select(node, F.lit("gap").alias("problem"), F.col(start).alias("at"))
    return empty.unionByName(broken).unionByName(gaps)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """left rows with the right row of equal keys whose window holds left.at; the latest start wins.
    Both sides lie on one time line of their key, where a row takes the last window that started. Only rows whose last
    window has ended are joined, with windows that outlive a later start; windows that follow each other have none."""
    fields = [c for c in right.columns if c not in keys]
    r = right.filter(" and ".join(f"`{c}` is not null" for c in (*keys, start))).select(*keys, F.struct(F.col(start).alias("_start"), *fields).alias("_hit"))
    later = F.lead("_hit._start").over(Window.partitionBy(*keys).orderBy("_hit"))
    outlives = r.withColumn("_next", later).filter(F.col("_next").isNotNull() & (F.col(f"_hit.{end}").isNull() | (F.col(f"_hit.{end}") > F.col("_next"))))
    line = left.select(*keys, F.col(at).alias("_at"), F.struct(*left.columns).alias("_l"))
    line = line.unionByName(r.select(*keys, F.col("_hit._start").alias("_at"), "_hit"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_l").isNotNull(), "_hit").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("_hit", F.last("_hit", True).over(w)).filter("_l is not null").select("_l", "_hit")
    covered = F.col(f"_hit.{end}").isNull() | (F.col("_l")[at] < F.col(f"_hit.{end}"))
    ended = rows.filter(~covered).select("_l", F.monotonically_increasing_id().alias("_row"))
    on = [F.col("_l")[k] == F.col(f"_{k}") for k in keys]
    inside = (F.col("_hit._start") <= F.col("_l")[at]) & (F.col(f"_hit.{end}").isNull() | (F.col("_l")[at] < F.col(f"_hit.{end}")))
    again = ended.join(outlives.select(*[F.col(k).alias(f"_{k}") for k in keys], "_hit"), on, "left").groupBy("_row").agg(F.first("_l").alias("_l"), F.max(F.when(inside, F.col("_hit"))).alias("_hit"))
    best = rows.filter(covered).unionByName(again.select("_l", "_hit"))
    return best.select("_l.*", *[F.col(f"_hit.{c}").alias(c) for c in fields if c not in left.columns])
