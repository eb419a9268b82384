"""The driver's tables seen as domain tables; each binding is SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VERSIONS = """
SELECT concat('u', user_id) AS node_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version,
  CAST(ts AS DATE) AS valid_from, CAST(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE) AS valid_to,
  CASE event_type WHEN 'error' THEN 'suspended' WHEN 'signup' THEN 'repealed' ELSE 'active' END AS status,
  CASE WHEN value > 20 THEN DATE '2024-01-15' END AS signed_before, CASE WHEN value < 5 THEN DATE '2024-01-20' END AS not_amended,
  CASE WHEN event_id % 7 = 0 THEN 'bank' END AS entity, event_id % 11 = 3 AS complemented,
  concat('text ', event_id % 4) AS body, concat('s', event_id % 3) AS scope_hash, event_id
FROM events
"""
NODES = "SELECT DISTINCT concat('u', user_id) AS node_id, concat('doc', user_id % 20) AS doc_key, concat('dieu:', user_id % 13, '/khoan:', user_id % 5) AS path FROM events"
ARTIFACTS = """
SELECT concat('doc', user_id % 20) AS doc_key, max(CASE (user_id % 20) % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END) AS audience
FROM events GROUP BY 1
"""
EDGES = "SELECT DISTINCT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem"
#: Operators on parts: seq makes the id unique within a part, as no column does.
OPS = """
SELECT concat('o', l_partkey, '.', seq) AS op_id, concat('p', l_partkey) AS node_id,
  CASE l_returnflag WHEN 'A' THEN 'amend' WHEN 'N' THEN 'suspend' ELSE 'repeal' END AS kind,
  seq, CAST(l_shipdate AS DATE) AS valid_from,
  CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 20 AS INT) END AS valid_to,
  concat('t', l_linenumber) AS new_text, s_nationkey AS issuer, s_nationkey % 5 AS rnk
FROM (SELECT l.*, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS INT) AS seq
      FROM lineitem l) x JOIN supplier ON l_suppkey = s_suppkey
"""


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the tables of a folder; only those that it names are opened."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


#: Rows that one task derives texts from.
DEALT = 5000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A narrow table's rows dealt by key before much longer texts are made of them: the file may be a single task's, and
    what is grouped by the key later stays where it is. Partitions grow with the rows."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // DEALT + 1)
    return rows.repartition(n, key)
