"""Registered queries of closures, document trees, quotations, references and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import quotes as qt
from ..functions import scope as sc
from ..functions import surface as sf
from ..operators import address as ad
from ..operators import amend as am
from ..operators import closure as cl
from ..operators import contain as ct
from ..operators import tree as tr
from ..operators import verify as vf
from .bindings import VERSIONS, bound, spread
from .catalog import _t, query

#: Six edges from each version, of all kinds; some without an end, some unresolved, some with a term.
TYPED_EDGES = """
SELECT event_id * 6 + j AS edge_id, node_id AS src, version AS src_version,
  CASE WHEN (event_id * 5 + j) % 43 = 0 THEN 'ngoai_le' ELSE CASE (event_id + j) % 5 WHEN 0 THEN 'chuyen_tiep' WHEN 1 THEN 'dinh_nghia' WHEN 2 THEN 'tham_quyen' WHEN 3 THEN 'dinh_nghia' ELSE 'chu_de' END END AS kind,
  CASE WHEN (event_id + 2 * j) % 23 = 0 THEN NULL ELSE concat('u', (event_id * 7 + j * 31) % 97) END AS dst,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat(' TEXT ', (event_id + j) % 5, ' ') END AS citation, (event_id + j) % 41 = 0 AS unresolved
FROM v CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(j)
"""
#: Each question has a date, a reader, and a cohort or none.
QUESTIONS = """
SELECT concat('q', c_custkey) AS qid, CAST(DATE '2024-01-02' + CAST(c_custkey % 27 AS INT) AS DATE) AS as_of, c_custkey % 3 AS reader, c_custkey % 4 > 0 AS cohort_known,
  CASE WHEN c_custkey % 4 = 1 THEN DATE '2024-01-10' END AS signed, CASE WHEN c_custkey % 4 = 2 THEN DATE '2024-01-25' END AS amended, CASE WHEN c_custkey % 4 = 3 THEN 'bank' END AS cohort_class, c_custkey
FROM customer
"""


@query("g01_closure")
def g01(spark, d):
    """Every customer's question, seeded with the versions in force of up to five nodes."""
    bound(spark, d, VERSIONS).withColumn("text", F.concat_ws(" ", "body", F.repeat(F.lit("word "), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 2500).otherwise(F.col("event_id") % 40).cast("int")))).createOrReplaceTempView("v")
    versions, edges = spark.table("v"), spark.sql(TYPED_EDGES)
    may = F.slice(F.array(F.lit("public"), F.lit("internal"), F.lit("restricted")), 1, (F.col("reader") + 1).cast("int"))
    questions = bound(spark, d, QUESTIONS).withColumn("entitlements", may)
    number = F.regexp_extract("node_id", "[0-9]+", 0).cast("long")
    nodes = versions.select("node_id").distinct().select("node_id", F.concat(F.lit("doc"), number % 20).alias("doc_key"), F.concat(F.lit("dieu:"), number % 13).alias("path"), F.when(number % 9 == 0, "restricted").when(number % 4 == 0, "internal").otherwise("public").alias("audience"))
    wanted = questions.select("qid", "as_of", "c_custkey", F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 5 + 1).cast("int"))).alias("rank"))
    wanted = wanted.withColumn("node_id", F.concat(F.lit("u"), (F.col("c_custkey") * 11 + F.col("rank") * 17) % 97))
    seeds = wanted.join(versions, "node_id").filter("status = 'active' and valid_from <= as_of and (valid_to is null or as_of < valid_to)").select("qid", "rank", "node_id", "version")
    value = sc.evaluate(F.col("signed_before"), F.col("not_amended"), F.col("entity"), F.col("signed"), F.col("amended"), F.col("cohort_class"))
    applies = sc.applies(F.col("signed_before").isNull() & F.col("not_amended").isNull() & F.col("entity").isNull(), F.col("complemented"), value)
    out = cl.closure(questions.drop("c_custkey", "reader"), seeds, edges, versions.drop("event_id", "body", "scope_hash"), nodes, applies)
    shown = F.array_join(F.transform("taken", lambda t: F.concat_ws(":", t["node_id"], t["version"], t["depth"], t["via"])), ",")
    return out.select("qid", shown.alias("taken"), "tokens", "complete", F.array_join("reasons", ",").alias("reasons"), F.array_join("flags", ",").alias("flags"))

# ---------------------------------------------------------------- trees and quotations

POINTS = "abcdđeghiklm"


def _laws(spark, d):
    """Customers as laws: articles, clauses and points in numbers that depend on the id, a quoted law among them, and
    an appendix after the sign-off."""
    c, points = F.col("c_custkey"), F.array(*map(F.lit, POINTS))
    point = lambda p: F.concat(p, F.lit(") Điểm "), p)
    quote = F.array(F.lit("“Điều 9. Giả"), F.lit("1. giả"), F.lit("a) giả”."))

    def clause(k):
        own = F.slice(points, 1, ((c + k) % 13).cast("int"))
        return F.flatten(F.array(F.array(F.concat(k, F.lit(". Khoản "), k)), F.when(k == 2, quote).otherwise(F.array().cast("array<string>")), F.transform(own, point)))

    def article(n):
        some = F.filter(F.sequence(F.lit(0), ((c + n) % 4).cast("int")), lambda k: k > 0)
        lead = F.when(n % 2 == 0, F.array(F.concat(F.lit("Lời dẫn "), n))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(F.array(F.concat(F.lit("Điều "), n, F.lit(". Tên "), n)), lead, F.flatten(F.transform(some, clause))))

    articles = F.flatten(F.transform(F.sequence(F.lit(1), (c % 4 + 1).cast("int")), article))
    head, tail = F.array(F.concat(F.lit("Số: "), c), F.lit("LUẬT"), F.lit("Chương I"), F.lit("QUY ĐỊNH")), F.array(F.lit("Nơi nhận:"), F.lit("1. bỏ"), F.lit("PHỤ LỤC"), F.lit("1. lời"))
    return spread(_t(spark, d, "customer").select("c_custkey"), "c_custkey").select(c.alias("doc_id"), F.array_join(F.concat(head, articles, tail), "\n").alias("text"))


@query(
    "p01_nodes",
    f"""
WITH c AS (SELECT c_custkey AS c FROM customer), a AS (SELECT c, n FROM c, unnest(range(1, c % 4 + 2)) AS t(n)),
k AS (SELECT c, n, k FROM a, unnest(range(1, (c + n) % 4 + 1)) AS t(k)), p AS (SELECT c, n, k, p FROM k, unnest(range(1, (c + k) % 13 + 1)) AS t(p)),
all_ AS (
  SELECT c, 0 AS n, 0 AS k, 0 AS p, 'preamble' AS path, NULL AS heading, concat('Số: ', c, chr(10), 'LUẬT') AS body FROM c
  UNION ALL SELECT c, n, 0, 0, concat('dieu:', n), concat('Tên ', n), CASE WHEN n % 2 = 0 THEN concat('Lời dẫn ', n) ELSE '' END FROM a
  UNION ALL SELECT c, n, k, 0, concat('dieu:', n, '/khoan:', k), NULL, concat('Khoản ', k, CASE WHEN k = 2 THEN concat(chr(10), '“Điều 9. Giả', chr(10), '1. giả', chr(10), 'a) giả”.') ELSE '' END) FROM k
  UNION ALL SELECT c, n, k, p, concat('dieu:', n, '/khoan:', k, '/diem:', substr('{POINTS}', p, 1)), NULL, concat('Điểm ', substr('{POINTS}', p, 1)) FROM p
  UNION ALL SELECT c, 99, 0, 0, 'phuluc:1', NULL, '1. lời' FROM c)
SELECT c AS doc_id, CAST(row_number() OVER (PARTITION BY c ORDER BY n, k, p) AS INTEGER) AS seq, path, heading, body, CASE WHEN n > 0 THEN 'Chương I QUY ĐỊNH' ELSE '' END AS chapter FROM all_
""",
)
def p01(spark, d):
    return tr.parse(_laws(spark, d)).select("doc_id", "seq", "path", "heading", "body", F.array_join(F.transform("chapter", lambda x: F.replace(x, F.lit("."), F.lit(""))), "|").alias("chapter"))


@query("a08_counts", "WITH c AS (SELECT c_custkey AS c FROM customer), a AS (SELECT c, n FROM c, unnest(range(1, c % 4 + 2)) AS t(n)), k AS (SELECT c, n, k FROM a, unnest(range(1, (c + n) % 4 + 1)) AS t(k)) SELECT c AS doc_id, count(DISTINCT n) AS articles, count(k) AS clauses, CAST(coalesce(sum((c + k) % 13), 0) AS BIGINT) AS points, CAST(1 AS BIGINT) AS appendices FROM a LEFT JOIN k USING (c, n) GROUP BY 1")
def a08_counts(spark, d):
    """Structural counts of each document."""
    n = lambda level: F.count(F.when(F.col("level") == level, 1))
    return tr.parse(_laws(spark, d)).groupBy("doc_id").agg(n("dieu").alias("articles"), n("khoan").alias("clauses"), n("diem").alias("points"), n("phuluc").alias("appendices"))


#: Turns as lines of one text each: nested, straight and closing marks.
QUOTED = "CASE turn % 7 WHEN 1 THEN '“mở' WHEN 2 THEN '“lồng” thêm “' WHEN 3 THEN '”' WHEN 4 THEN '” ”' WHEN 5 THEN 'một \" dấu' WHEN 6 THEN '\"đủ\"' ELSE role END"


@query(
    "p03_quotes",
    f"""
WITH l AS (SELECT conv_id, turn, {QUOTED} AS raw FROM conversations),
s AS (SELECT *, list(len(raw) - len(replace(raw, '“', '')) - len(raw) + len(replace(raw, '”', ''))) OVER w AS deltas, sum(len(raw) - len(replace(raw, '"', ''))) OVER w AS straight FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, coalesce(list_reduce(list_prepend(0, deltas), lambda a, x: greatest(0, a + x)), 0) > 0 OR coalesce(straight, 0) % 2 = 1 OR left(raw, 1) IN ('“', '"') AS in_quote FROM s
""",
)
def p03(spark, d):
    _t(spark, d, "conversations").createOrReplaceTempView("turns")
    rows = spark.sql(f"SELECT conv_id AS doc_id, turn AS line_no, {QUOTED} AS raw FROM turns")
    return tr.quoted(rows.withColumn("line", tr.strip(F.col("raw")))).select(F.col("doc_id").alias("conv_id"), F.col("line_no").alias("turn"), "in_quote")


_ORDERED = "SELECT l_orderkey AS g, concat(l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber > 1 THEN 'a' ELSE '' END) AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_returnflag, l_partkey, l_suppkey) AS pos FROM lineitem"


@query(
    "h21_sequence",
    f"""
WITH l AS (SELECT *, CAST(regexp_extract(label, '[0-9]+') AS INTEGER) AS b, label LIKE '%a' AS s FROM ({_ORDERED}) x),
e AS (SELECT *, coalesce((SELECT l2.b FROM l l2 WHERE l2.g = l.g AND l2.pos < l.pos AND NOT l2.s ORDER BY l2.pos DESC LIMIT 1), 0) AS before FROM l)
SELECT g AS "group", CAST(pos AS INTEGER) AS "at", label, CAST(CASE WHEN s THEN before ELSE before + 1 END AS VARCHAR) AS expected FROM e WHERE b <> CASE WHEN s THEN before ELSE before + 1 END
""",
)
def h21(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem_h21")
    rows = spark.sql(_ORDERED.replace("FROM lineitem", "FROM lineitem_h21")).withColumnRenamed("g", "group").withColumn("at", F.col("pos").cast("int"))
    return tr.sequence_gaps(rows.select("group", "at", "label"))


@query("h22_alphabet", "WITH l AS (SELECT user_id AS g, event_id AS pos, substr('abcdđe', CAST(event_id % 7 AS INT) + 1, 1) AS label, lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_id % 7 < 6) SELECT g AS \"group\", pos AS \"at\", label, CASE WHEN coalesce(p, -1) + 1 < 6 THEN substr('abcdđe', CAST(coalesce(p, -1) + 2 AS INT), 1) ELSE '?' END AS expected FROM l WHERE pos % 7 <> 0 AND pos % 7 <> coalesce(p, -1) + 1 UNION ALL SELECT user_id, event_id, 'z', NULL FROM events WHERE event_id % 7 = 6")
def h22(spark, d):
    label = F.when(F.col("event_id") % 7 < 6, F.substring(F.lit("abcdđe"), (F.col("event_id") % 7 + 1).cast("int"), F.lit(1))).otherwise("z")
    return tr.sequence_gaps(_t(spark, d, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("at"), label.alias("label")), "abcdđe")


@query("x24_spans", "SELECT doc_id, concat(4, ':', 6 + len(text)) AS spans, concat(4, ':', 6 + len(text)) AS block FROM (SELECT doc_id, replace(replace(replace(coalesce(text, ''), '“', ''), '”', ''), '\"', '') AS text FROM documents) x")
def x24(spark, d):
    """Each document's whole text as a quotation after a few letters."""
    text = F.translate(F.coalesce("text", F.lit("")), '“”"', "")
    quoted = F.concat(F.lit("nói “"), text, F.lit("” rồi"))
    show = lambda p: F.concat_ws(":", p["start"], p["stop"])
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.transform(qt.quoted_spans(quoted), show), ",").alias("spans"), show(qt.quote_block(quoted, F.lit(1))).alias("block"))


@query("p09_roles", "WITH c AS (SELECT c_custkey AS c FROM customer), a AS (SELECT c, n FROM c, unnest(range(1, 6)) AS t(n)), k AS (SELECT c, n, k FROM a, unnest(range(1, 3)) AS t(k)) SELECT c AS doc_id, concat('dieu:', n) AS path, CASE (c + n) % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'transition' WHEN 2 THEN 'effectivity' WHEN 3 THEN 'amending' ELSE 'rule' END AS role FROM a UNION ALL SELECT c, concat('dieu:', n, '/khoan:', k), CASE (c + n) % 5 WHEN 0 THEN 'definition' WHEN 3 THEN 'amending' ELSE CASE WHEN k = 2 AND c % 2 = 0 THEN 'amending' ELSE CASE (c + n) % 5 WHEN 1 THEN 'transition' WHEN 2 THEN 'effectivity' ELSE 'rule' END END END FROM k")
def p09(spark, d):
    """Roles of five articles with two clauses each, by every kind of heading, inherited and overruled."""
    c = F.col("c_custkey")
    heading = lambda n: F.element_at(F.array(*map(F.lit, ("Giải thích từ ngữ", "Quy định chuyển tiếp", "Hiệu lực thi hành", "Sửa đổi khoản 2 như sau", "Mức cho vay"))), ((c + n) % 5 + 1).cast("int"))
    second = F.when(c % 2 == 0, F.lit("2. Bãi bỏ khoản 5 “cũ”")).otherwise("2. Áp dụng “mới”")
    article = lambda n: F.concat(F.lit("Điều "), n, F.lit(". "), heading(n), F.lit("\n1. Một\n"), second)
    docs = spread(_t(spark, d, "customer").select("c_custkey"), "c_custkey").select(c.alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), article), "\n").alias("text"))
    return tr.roles(tr.parse(docs)).select("doc_id", "path", "role")

# ---------------------------------------------------------------- printed addresses, resolution, terms

_REFERENCE = """
SELECT o_orderkey AS id, concat('theo quy định tại ', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'điểm a ' WHEN 2 THEN 'các điểm a và b ' ELSE 'các điểm a, b, c và đ ' END,
  'khoản ', o_orderkey % 20 + 1, CASE WHEN o_orderkey % 4 > 0 THEN '' ELSE concat(', khoản ', o_orderkey % 20 + 2, CASE WHEN o_orderkey % 3 = 0 THEN concat(' hoặc ', o_orderkey % 20 + 3, 'a') ELSE '' END) END,
  ' Điều ', o_orderkey % 150 + 1, ' ', CASE o_orderkey % 5 WHEN 0 THEN 'Thông tư này' WHEN 1 THEN 'của Thông tư số 39/2016/TT-NHNN' WHEN 2 THEN 'Luật Các tổ chức ngày 1 tháng 2 năm 2010' WHEN 3 THEN ', khoản 7 Điều này' ELSE 'thì cho vay' END, '; Phụ lục ', o_orderkey % 9 + 1, '.') AS text
FROM orders
"""


@query(
    "p10_paths",
    """
WITH o AS (SELECT o_orderkey AS id, concat('dieu:', o_orderkey % 150 + 1, '/khoan:') AS base, o_orderkey % 20 + 1 AS k, concat('phuluc:', o_orderkey % 9 + 1) AS p FROM orders),
a AS (SELECT id, p, CASE WHEN id % 4 > 0 THEN array_to_string(list_transform(['a', 'b', 'c', 'đ'][1:CASE id % 4 WHEN 3 THEN 4 ELSE id % 4 END], lambda x: concat(base, k, '/diem:', x)), ',')
  ELSE concat(base, k, ',', base, k + 1, CASE WHEN id % 3 = 0 THEN concat(',', base, k + 2, 'a') ELSE '' END) END AS first FROM o)
SELECT id, concat(first, CASE id % 5 WHEN 0 THEN '@this' WHEN 1 THEN '@Thông tư số 39/2016/TT-NHNN' WHEN 2 THEN '@Luật Các tổ chức ngày 1 tháng 2 năm 2010' WHEN 3 THEN ',khoan:7@dieu' ELSE '@' END, ' ', p, '@') AS found FROM a
""",
)
def p10(spark, d):
    show = lambda g: F.concat(F.array_join(g["paths"], ","), F.lit("@"), F.coalesce(g["document"], F.when(g["this"], "this"), g["relative"], F.lit("")))
    return bound(spark, d, _REFERENCE).select("id", F.array_join(F.transform(sf.references(F.col("text")), show), " ").alias("found"))


_ALIASES = "SELECT concat('d', user_id % 20) AS doc_key, concat('dieu:', event_id % 97, '/khoan:', event_id % 11) AS path, concat('n', event_id % 5000) AS node_id, CAST(ts AS DATE) AS valid_from, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) + CAST(event_id % 9 + 1 AS INT) AS DATE) END AS valid_to FROM events"
_BORN = "SELECT concat('b', event_id % 3000) AS node_id, concat('d', (user_id + event_id) % 20) AS doc_key, concat('dieu:', event_id % 97, CASE WHEN event_id % 4 > 0 THEN concat('/khoan:', event_id % 11) ELSE '' END) AS path FROM events"
_ASKS = "SELECT event_id AS ask_id, concat('d', (user_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 20) AS doc_key, concat('dieu:', event_id % 97, '/khoan:', event_id % 11, CASE WHEN event_id % 3 = 0 THEN '/diem:a' ELSE '' END) AS path, CAST(CAST(ts AS DATE) + CAST(event_id % 21 - 10 AS INT) AS DATE) AS at_ FROM events"


@query(
    "r01_resolve",
    f"""
WITH al AS (SELECT DISTINCT * FROM ({_ALIASES}) x), nd AS (SELECT DISTINCT * FROM ({_BORN}) x), ask AS ({_ASKS}),
tried AS (SELECT ask_id, doc_key, at_, path AS asked, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM ask, unnest(range(1, len(string_split(path, '/')) + 1)) AS t(k)),
named AS (SELECT * FROM tried JOIN al USING (doc_key, path)),
c AS (SELECT *, rank() OVER (PARTITION BY ask_id, path ORDER BY valid_from DESC) AS r FROM named WHERE valid_from <= at_ AND (valid_to IS NULL OR at_ < valid_to)),
steps AS (
  SELECT ask_id, asked, path, 1 AS step, count(*) AS n, min(node_id) AS node_id FROM c WHERE r = 1 GROUP BY ALL
  UNION ALL SELECT ask_id, asked, path, 2, count(*), min(node_id) FROM named WHERE valid_from > at_ GROUP BY ALL HAVING count(*) = 1
  UNION ALL SELECT ask_id, asked, path, 3, count(*), min(node_id) FROM tried JOIN nd USING (doc_key, path) GROUP BY ALL HAVING count(*) = 1),
best AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY length(path) DESC, step) = 1)
SELECT ask_id, CASE WHEN n = 1 THEN node_id END AS node_id, CASE WHEN n > 1 THEN 'tied' WHEN best.path <> asked THEN 'ancestor' ELSE ['covered', 'future', 'provisional'][step] END AS how, best.path AS path FROM ask LEFT JOIN best USING (ask_id)
""",
)
def r01(spark, d):
    asks = bound(spark, d, _ASKS).withColumnRenamed("at_", "at")
    return ad.resolve(asks, bound(spark, d, _ALIASES), bound(spark, d, _BORN), ancestors=True)


@query(
    "r03_find_document",
    """
WITH doc AS (SELECT concat(p_partkey, '/', p_size) AS doc_key, DATE '2000-01-01' + CAST(p_partkey * 7 % 3000 AS INT) AS issued, lower(p_name) AS title FROM part),
ask AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat(c_custkey, '/', c_custkey % 50 + 1) END AS number, CASE WHEN c_custkey % 3 = 1 THEN DATE '2000-01-01' + CAST(c_custkey % 3000 AS INT) END AS issued, lower(concat(CASE WHEN c_custkey % 2 = 0 THEN 'x ' ELSE '' END, p_name, CASE WHEN c_custkey % 2 = 0 THEN ' y' ELSE '' END)) AS hint FROM customer LEFT JOIN part ON p_partkey = c_custkey % 500),
e AS (SELECT id, doc_key FROM ask JOIN doc ON number = doc_key),
i AS (SELECT id, min(doc_key) AS doc_key FROM ask JOIN doc USING (issued) WHERE number IS NULL GROUP BY 1 HAVING count(DISTINCT doc_key) = 1),
h AS (SELECT id, min(doc_key) AS doc_key FROM ask JOIN doc ON contains(title, hint) OR (length(title) > 8 AND contains(hint, title)) WHERE number IS NULL AND id NOT IN (SELECT id FROM i) GROUP BY 1 HAVING count(DISTINCT doc_key) = 1)
SELECT id AS ask_id, coalesce(e.doc_key, i.doc_key, h.doc_key) AS doc_key FROM ask LEFT JOIN e USING (id) LEFT JOIN i USING (id) LEFT JOIN h USING (id)
""",
)
def r03(spark, d):
    p, c = _t(spark, d, "part"), _t(spark, d, "customer")
    start = F.lit("2000-01-01").cast("date")
    docs = p.select(F.concat_ws("/", "p_partkey", "p_size").alias("doc_key"), F.date_add(start, (F.col("p_partkey") * 7 % 3000).cast("int")).alias("issued"), F.col("p_name").alias("title"))
    k = F.col("c_custkey")
    around = lambda s: F.when(k % 2 == 0, s).otherwise("")
    # The remainder reaches no other parts: the whole table is not sent to every task.
    named = p.filter("p_partkey between -499 and 499")
    asks = c.join(named, named["p_partkey"] == k % 500, "left").select(
        k.alias("ask_id"), F.when(k % 3 == 0, F.concat(k, F.lit("/"), k % 50 + 1)).alias("number"), F.when(k % 3 == 1, F.date_add(start, (k % 3000).cast("int"))).alias("issued"),
        F.concat(around("x "), F.coalesce(F.upper("p_name"), F.lit("")), around(" y")).alias("hint"),
    )
    return ad.find_document(asks, docs)


@query("r10_shorthand", "WITH doc AS (SELECT DISTINCT concat('0', c_custkey % 1000, '/', c_nationkey) AS doc_key, CAST(c_custkey % 1000 AS VARCHAR) AS n FROM customer), one AS (SELECT nullif(n, '0') AS n, min(doc_key) AS doc_key FROM doc WHERE n <> '0' GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey AS ask_id, doc_key FROM supplier LEFT JOIN one ON n = CAST(s_suppkey AS VARCHAR)")
def r10(spark, d):
    docs = _t(spark, d, "customer").select(F.concat(F.lit("0"), F.col("c_custkey") % 1000, F.lit("/"), "c_nationkey").alias("doc_key")).filter("c_custkey % 1000 <> 0")
    return ad.resolve_shorthand(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("ask_id"), F.concat(F.lit("00"), "s_suppkey").alias("number")), docs)


@query(
    "j21_terms",
    """
WITH n AS (SELECT o_custkey AS doc_id, concat('dieu:', o_orderkey, '/khoan:1') AS path, o_orderstatus = 'F' AS defines, lower(concat(o_orderpriority, ' ', o_orderkey % 10)) AS term, concat('về ', lower(o_orderpriority), ' ', o_orderkey % 10, o_orderkey % 3, ' và ', lower(o_orderpriority), ' ', o_orderkey % 7) AS body FROM orders)
SELECT DISTINCT b.doc_id, b.path AS src_path, a.term, a.path AS dst_path FROM n a JOIN n b USING (doc_id) WHERE a.defines AND NOT b.defines AND contains(b.body, a.term)
""",
)
def j21(spark, d):
    """Orders as clauses of their customer's law: finished ones define a term, the others use some."""
    o = _t(spark, d, "orders")
    k, name = F.col("o_orderkey"), F.col("o_orderpriority")
    body = F.when(F.col("o_orderstatus") == "F", F.concat(name, F.lit(" "), k % 10, F.lit(" là việc"))).otherwise(F.concat(F.lit("Về "), F.lower(name), F.lit(" "), k % 10, k % 3, F.lit(" và "), name, F.lit(" "), k % 7))
    nodes = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("dieu:"), k, F.lit("/khoan:1")).alias("path"), F.lit("khoan").alias("level"), F.when(F.col("o_orderstatus") == "F", "definition").otherwise("rule").alias("role"), F.lit(None).cast("string").alias("heading"), body.alias("body"))
    return ct.term_edges(nodes)

# ---------------------------------------------------------------- answers


@query("v14_verify")
def v14_verify(spark, d):
    """Every document's beginning quoted from it, with edits in some, under its own and its neighbour's text; tags and
    numbers that may be missing."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    quote = F.translate(F.substring(text, F.lit(1), (k % 120 + 12).cast("int")), "“”\"«»\n", "")
    edited = F.when(k % 3 == 0, F.concat(F.lit("Sửa "), quote)).when(k % 3 == 1, F.regexp_replace(quote, "a", "o")).otherwise(quote)
    docs = _t(spark, d, "documents").select(k.alias("answer_id"), text.alias("text"), edited.alias("quote"))
    refs = F.array(F.lit("[1]"), F.when(F.col("answer_id") % 5 == 0, "[3]").otherwise("[2]"))
    claims = docs.select("answer_id", F.lit("c").alias("claim_id"), F.concat(F.lit("“"), "quote", F.lit("” [1] "), F.col("answer_id") % 50).alias("text"), refs.alias("refs"))
    answers = docs.select("answer_id", F.concat(F.lit("[1] [2] ["), F.col("answer_id") % 4, F.lit("] “"), F.upper("quote"), F.lit("”")).alias("answer"), F.array((F.col("answer_id") % 10).cast("string")).alias("numbers"))
    context = docs.select("answer_id", F.lit("[1]").alias("ref"), "text").unionByName(docs.select((F.col("answer_id") + 1).alias("answer_id"), F.lit("[2]").alias("ref"), "text"))
    bases = docs.select("answer_id", F.concat(F.lit("["), F.col("answer_id") % 3, F.lit("]")).alias("ref"))
    out = vf.verify(answers, claims, bases, context)
    return out.withColumn("detail", F.md5(F.col("detail").cast("binary")))


# ---------------------------------------------------------------- amendments

_CLAUSES = """
SELECT o_orderkey AS doc_id, 'dieu:1' AS path, DATE '2024-09-01' AS effective, concat(
  CASE o_orderkey % 4 WHEN 0 THEN concat('Bổ sung khoản ', k, ', khoản ', k + 1, ' Điều ', d, ' như sau:', chr(10), '“', k, '. Bãi bỏ khoản 9 Điều 9', chr(10), 'a) điểm', chr(10), k + 1, '. Hai”.')
    WHEN 1 THEN concat('Bãi bỏ điểm a và điểm b khoản ', k, ' Điều ', d, ' kể từ ngày 1/', o_orderkey % 12 + 1, '/2025.') WHEN 2 THEN concat('Thay thế cụm từ “cũ ', k, '” bằng cụm từ “mới” tại khoản ', k, ' Điều ', d, ' Thông tư số 39/2016/TT-NHNN.')
    ELSE concat('Ngưng hiệu lực thi hành khoản ', k, ' Điều ', d, ' từ ngày 1 tháng 9 năm 2023 cho đến ngày có hiệu lực của văn bản mới') END,
  chr(10), 'Sửa đổi khoản 3 Điều ', d, ' như sau: “3. Ba”') AS text
FROM (SELECT o_orderkey, o_orderkey % 20 + 1 AS k, o_orderkey % 150 + 1 AS d FROM orders) x
"""


@query(
    "p24_operators",
    """
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 20 + 1 AS k, o_orderkey % 150 + 1 AS d, o_orderkey % 4 AS m, i FROM orders, unnest([0, 1, 2]) AS t(i)),
x AS (SELECT *, i = 2 AS tail FROM o WHERE i <> 1 OR m < 2)
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS seq, CASE WHEN tail OR m = 2 THEN 'amend' WHEN m = 0 THEN 'insert' WHEN m = 1 THEN 'repeal' ELSE 'suspend' END AS kind,
  concat('dieu:', d, '/khoan:', CASE WHEN tail THEN '3' WHEN m = 0 THEN CAST(k + i AS VARCHAR) WHEN m = 1 THEN concat(k, '/diem:', ['a', 'b'][i + 1]) ELSE CAST(k AS VARCHAR) END) AS target_path,
  CASE WHEN m = 2 AND NOT tail THEN 'Thông tư số 39/2016/TT-NHNN' END AS document, CASE WHEN tail THEN '3. Ba' WHEN m = 0 AND i = 0 THEN concat(k, '. Bãi bỏ khoản 9 Điều 9', chr(10), 'a) điểm') WHEN m = 0 THEN concat(k + 1, '. Hai') END AS new_text,
  CASE WHEN m = 2 AND NOT tail THEN concat('cũ ', k) END AS phrase_from, CASE WHEN tail THEN DATE '2024-09-01' WHEN m = 1 THEN make_date(2025, CAST(id % 12 + 1 AS INT), 1) WHEN m = 3 THEN DATE '2023-09-01' ELSE DATE '2024-09-01' END AS valid_from,
  CASE WHEN m = 3 AND NOT tail THEN 'đến ngày có hiệu lực của văn bản mới' END AS valid_to_event
FROM x
""",
)
def p24(spark, d):
    spread(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey").createOrReplaceTempView("orders_p24")
    return am.operators(spark.sql(_CLAUSES.replace("FROM orders", "FROM orders_p24"))).select("doc_id", "seq", "kind", "target_path", "document", "new_text", "phrase_from", "valid_from", "valid_to_event")


@query(
    "p39_replacements",
    """
WITH o AS (SELECT l_partkey AS node_id, concat(l_orderkey, '.', l_linenumber, '.', l_suppkey, '.', l_shipdate) AS op_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS seq, concat('v', l_linenumber % 3) AS a, concat('v', l_suppkey % 3) AS b FROM lineitem),
g AS (SELECT node_id, list(struct_pack(op_id, a, b) ORDER BY seq) AS ops FROM o GROUP BY 1),
r AS (SELECT node_id, ops, unnest(range(1, len(ops) + 1)) AS i FROM g)
SELECT node_id, ops[i].op_id AS op_id, t.old_text AS old_text, replace(t.old_text, ops[i].a, ops[i].b) AS new_text, contains(t.old_text, ops[i].a) AS found
FROM (SELECT *, struct_pack(old_text := list_reduce(list_prepend(struct_pack(op_id := '', a := '', b := 'v0 v1 v2'), ops[1:i - 1]), lambda x, y: struct_pack(op_id := '', a := '', b := replace(x.b, y.a, y.b))).b) AS t FROM r)
""",
)
def p39(spark, d):
    """Each part's text under all its lines' replacements, in order of shipping."""
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    phrase = lambda c: F.concat(F.lit("v"), F.col(c) % 3)
    ops = _t(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("op_id"), F.col("l_partkey").alias("node_id"), F.row_number().over(w).alias("seq"), phrase("l_linenumber").alias("phrase_from"), phrase("l_suppkey").alias("phrase_to"))
    bodies = ops.select("node_id").distinct().withColumn("body", F.lit("v0 v1 v2"))
    return am.materialise(ops, bodies)
