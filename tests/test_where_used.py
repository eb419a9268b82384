"""Where-used, address resolution and document names: equal keys meet once, with plain versions' results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from chronofold.operators import address as ad
from chronofold.operators import graph as gr


def test_where_used_gives_each_pair_once_and_shuffles_none(spark):
    r = random.Random(3)
    edges = [(f"p{r.randrange(30)}", d, f"n{d}" if d % 2 else None) for d in (r.randrange(12) for _ in range(150))]
    edges = [(s, f"s{d}", n) for s, d, n in edges] + [(None, "s1", "n1")]
    targets = [(f"o{r.randrange(9)}", f"s{r.randrange(14)}", r.choice(["a", "b", "c", None])) for _ in range(25)]
    norms = [(f"n{k}", r.choice("abc")) for k in range(0, 12)] * 2
    got = gr.where_used(spark.createDataFrame(edges, "src string, dst string, dst_norm string"), spark.createDataFrame(targets, "op_id string, node_id string, artifact_id string"), spark.createDataFrame(norms, "norm_id string, artifact_id string"))
    want = {(o, s) for o, n, _ in targets for s, d, _ in edges if n == d} | {(o, s) for o, _, a in targets for m, b in norms if a == b for s, _, k in edges if k == m}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_where_used_makes_its_pairs_in_many_tasks(spark):
    """One artifact's operators and sources are few rows and many pairs: these are made in as many tasks as cores at
    least, whatever Spark makes of small shuffles."""
    edges = spark.range(3000).selectExpr("concat('p', id) AS src", "'s1' AS dst", "'n1' AS dst_norm")
    targets = spark.range(2500).selectExpr("concat('o', id) AS op_id", "'s2' AS node_id", "'a' AS artifact_id")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        got = gr.where_used(edges, targets, spark.createDataFrame([("n1", "a")], "norm_id string, artifact_id string"))
        made = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(made) == 7_500_000 and max(made) < 7_500_000


def test_questions_of_one_address_and_date_look_it_up_once(spark):
    """The join with the aliases has a row for each date and window of an address, not for each question and alias."""
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    asks = spark.createDataFrame([(i, "d", "dieu:1", day(i % 3)) for i in range(300)], "ask_id int, doc_key string, path string, at date")
    aliases = spark.createDataFrame([("d", "dieu:1", f"n{i:03}", day(0), None) for i in range(200)], "doc_key string, path string, node_id string, valid_from date, valid_to date")
    got = ad.resolve(asks, aliases, spark.createDataFrame([], "node_id string, doc_key string, path string"))
    assert {(x.node_id, x.how, x.path) for x in got.collect()} == {(None, "tied", "dieu:1")} and got.count() == 300
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("count(1) AS n") >= 1


def _joined(node):
    """The rows that each join of an executed plan gave."""
    found = [node.metrics().get("numOutputRows").get().value()] if "Join" in node.nodeName() else []
    return found + [n for k in range(node.children().size()) for n in _joined(node.children().apply(k))]


def test_questions_of_a_date_do_not_meet_its_documents_one_by_one(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    docs = [(f"d{i:03}", day(i % 2), None) for i in range(200)] + [("only", day(5), None), ("only", day(5), None), (None, day(5), None), ("none", None, None)]
    asks = [(i, None, day(i % 2), None) for i in range(200)] + [(300, None, day(5), None), (301, "", day(5), None), (302, None, None, None), (303, None, day(7), None)]
    got = ad.find_document(spark.createDataFrame(asks, "ask_id int, number string, issued date, hint string"), spark.createDataFrame(docs, "doc_key string, issued date, title string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 204 and {r for r in rows if r[1]} == {(300, "only"), (301, "only")}
    assert max(_joined(got._jdf.queryExecution().executedPlan())) <= 204
