"""Narrow tables dealt by key: one shuffle, and none for what is grouped by the key later."""

from chronofold.operators import amend as am
from chronofold.operators import tree as tr
from chronofold.plans import bindings
from pyspark.sql import functions as F


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_are_dealt_to_more_tasks_as_they_grow(spark):
    few, many = spark.range(3), spark.range(2 * bindings.DEALT, numPartitions=1)
    assert bindings.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert bindings.spread(many, "id").rdd.getNumPartitions() == 3


def test_documents_and_clauses_are_shuffled_once_by_their_key(spark):
    ids = bindings.spread(spark.range(50), "id").select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.lit("Điều 1. Tên\n1. Khoản\na) điểm\nvà lời\nb) điểm"))
    assert _shuffles(tr.parse(docs)) == 1
    assert _shuffles(tr.roles(tr.parse(docs))) == 1
    assert tr.roles(tr.parse(docs)).count() == 200
    clauses = ids.select("doc_id", F.lit("dieu:1").alias("path"), F.lit("Bãi bỏ khoản 1 Điều 2.").alias("text"), F.current_date().alias("effective"))
    plan = am.operators(clauses)
    assert _shuffles(plan) == 1 and plan.count() == 50
    # What is exploded is not worked out a second time in a filter below.
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in optimized and "Filter ((size(" not in optimized


def test_a_text_that_holds_the_sign_of_a_cut_is_split_by_the_pattern(spark):
    from chronofold.functions.quotes import quoted_spans

    rows = spark.createDataFrame([("a\x01“b”\x01 “c”",), ("a “b” “c”",)], "t string")
    got = [[(p["start"], p["stop"]) for p in r[0]] for r in rows.select(quoted_spans(F.col("t"))).collect()]
    assert got == [[(2, 5), (7, 10)], [(2, 5), (6, 9)]]
