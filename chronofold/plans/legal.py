"""Registered queries of legal texts and of the desk, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal as lg
from ..functions import temporal as tp
from ..functions import text as tx
from ..operators import desk
from .bindings import EDGES, NODES, OPS, VERSIONS, bound
from .catalog import OPS_WITH, _t, query

#: Orders as legal papers: number with stray blanks, a date that may be none, a title and a body.
PAPERS = """
SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_orderdate, kind, number, concat(kind, ' số ', number) AS title,
  concat(kind, ' số ', number, ' ngày ', d, CASE WHEN o_orderkey % 2 = 0 THEN concat(' tháng ', m, ' năm ', y) ELSE concat('/', m, '/', y) END,
    ' về lãi suất ', CASE o_orderkey % 4 WHEN 0 THEN 'ngắn hạn' WHEN 1 THEN 'trung hạn' WHEN 2 THEN 'dài hạn' ELSE 'cho vay' END, ': “không vượt quá ', o_orderkey % 17, ',5 %/năm” và tối đa ', o_orderkey % 13, '%/năm.') AS body,
  CASE o_orderkey % 8 WHEN 0 THEN concat('quy dinh ngay ', d, ' thang ', m, ' nam ', y) WHEN 1 THEN concat('tai ', d, '/', m, '/', y) WHEN 2 THEN concat('thang ', m, '/', y) WHEN 3 THEN concat('nam ', y)
    WHEN 4 THEN 'hien nay lai suat' WHEN 5 THEN 'sap toi thay doi' WHEN 6 THEN concat('khoan vay ky truoc ', d, '/', m, '/', y) ELSE concat('khoan vay ky thang ', m, '/', y) END AS question
FROM (SELECT *, day(o_orderdate) + CASE WHEN o_orderkey % 6 = 0 THEN 3 ELSE 0 END AS d, month(o_orderdate) AS m, year(o_orderdate) AS y,
  CASE o_orderkey % 4 WHEN 0 THEN 'Thông tư' WHEN 1 THEN 'Nghị quyết' WHEN 2 THEN 'Luật' ELSE 'Quyết định' END AS kind,
  concat(o_orderkey % 900 + 1, ' /', year(o_orderdate), '/', CASE o_orderkey % 5 WHEN 0 THEN 'TT' WHEN 1 THEN 'NĐ' WHEN 2 THEN 'XX' WHEN 3 THEN 'QĐ' ELSE 'NQ' END, '- ', CASE o_orderkey % 3 WHEN 0 THEN 'NHNN' WHEN 1 THEN 'CP' ELSE 'HĐTP' END) AS number
  FROM orders) x
"""
P = f"WITH p AS ({PAPERS})"
#: Versions whose windows close within their own scope, so that several scopes are valid at a time.
BRANCHES = "SELECT concat('u', user_id) AS node_id, concat('s', event_id % 3) AS scope_hash, CAST(ts AS DATE) AS valid_from, CAST(lead(ts) OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS DATE) AS valid_to FROM events"
_RATES = "regexp_extract_all(body, '(?i)(?:tối\\s*đa|không\\s*vượt\\s*quá)[^0-9%]{0,80}?([0-9]+(?:[.,][0-9]+)?)\\s*%\\s*/\\s*năm', 1)"
_D = "try_cast(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS DATE)"


def _at(column: str, pattern: str) -> str:
    d, m, y = (f"regexp_extract({column}, '{pattern}', {k})" for k in (1, 2, 3))
    return f"CASE WHEN regexp_matches({column}, '{pattern}') THEN {_D.format(d=d, m=m, y=y)} END"


_WORDS, _SLASHES = r"ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{4})", r"ngày\s+([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"

# ---------------------------------------------------------------- texts


@query("x01_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def x01(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(lg.nfc("text").cast("binary")).alias("digest"))


@query("x07_normalized", "SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g'))) AS digest FROM documents")
def x07(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(lg.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query("x03_glued_numbers", f"{P} SELECT id, regexp_replace(body, '([0-9]{{1,4}})\\s*/\\s*([0-9]{{4}})\\s*/\\s*((?:TT|NĐ|QĐ|NQ)[0-9]*)\\s*-\\s*([A-ZĐ][A-ZĐ0-9]{{0,11}})', '\\1/\\2/\\3-\\4', 'g') AS body FROM p")
def x03(spark, d):
    return bound(spark, d, PAPERS).select("id", lg.glue_numbers(F.col("body")).alias("body"))


@query("x05_collapsed", "SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '[\\t ]+', ' ', 'g'), ' (\\n)| $', '\\1', 'g')) AS digest FROM conversations")
def x05(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.collapse_spaces(F.col("text")).cast("binary")).alias("digest"))


@query("x09_doc_numbers", f"{P} SELECT id, upper(regexp_replace(number, '\\s+', '', 'g')) AS numbers FROM p")
def x09(spark, d):
    return bound(spark, d, PAPERS).select("id", F.array_join(lg.loose_numbers(F.col("body")), ",").alias("numbers"))


@query("x11_plain", "SELECT c_custkey, strip_accents(replace(replace(s, 'đ', 'd'), 'Đ', 'D')) AS plain FROM (SELECT c_custkey, concat(c_name, ' Đường điện ', c_mktsegment, ' ữ ặ ỗ') AS s FROM customer)")
def x11(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", lg.strip_diacritics(F.concat("c_name", F.lit(" Đường điện "), "c_mktsegment", F.lit(" ữ ặ ỗ"))).alias("plain"))


@query("x12_dates", f"{P} SELECT id, CASE WHEN regexp_matches(body, '{_WORDS}') THEN {_at('body', _WORDS)} ELSE {_at('body', _SLASHES)} END AS at FROM p")
def x12(spark, d):
    return bound(spark, d, PAPERS).select("id", lg.parse_date(F.col("body")).alias("at"))


@query("x13_unquoted", "SELECT page_id, trim(url) AS url FROM pages")
def x13(spark, d):
    quoted = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" “ "), "url", F.lit("”."))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('"'), "url", F.lit('"'))).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", lg.unquote(quoted).alias("url"))


@query("x14_next_letter", "SELECT c_custkey, substr('ăâbcdđeêghiklmnoôơpqrstuưvxy', CAST(c_custkey % 30 AS INT) + 1, 1) AS follows FROM customer WHERE c_custkey % 30 < 28 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 30 >= 28")
def x14(spark, d):
    letter = F.substring(F.lit(tx.LETTERS + "!"), (F.col("c_custkey") % 30 + 1).cast("int"), F.lit(1))
    return _t(spark, d, "customer").select("c_custkey", tx.next_letter(letter).alias("follows"))


@query("x21_first_number", f"{P} SELECT id, CASE WHEN id % 3 = 0 THEN concat(id % 10000, '/QĐ-TT') END AS number FROM p")
def x21(spark, d):
    body = F.when(F.col("id") % 3 == 0, F.concat(F.lit("theo "), F.col("id") % 10000, F.lit("/QĐ-TTg"))).otherwise(F.col("kind"))
    return bound(spark, d, PAPERS).select("id", lg.first_number(body).alias("number"))


@query("x25_prefixes", f"WITH n AS ({NODES}) SELECT node_id, concat(split_part(path, '/', 1), '|', path) AS prefixes, split_part(path, '/', 1) AS top FROM n")
def x25(spark, d):
    path = F.col("path")
    return bound(spark, d, NODES).select("node_id", F.array_join(tx.path_prefixes(path), "|").alias("prefixes"), F.substring_index(path, "/", 1).alias("top"))


@query("x29_quotes", f"{P} SELECT id, array_to_string(regexp_extract_all(body, '“([^”]{{10,}})”', 1), '|') AS quotes FROM p")
def x29(spark, d):
    return bound(spark, d, PAPERS).select("id", F.array_join(tx.quotes(F.col("body")), "|").alias("quotes"))


@query("x33_chunks")
def x33(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(lg.chunks(F.col("text"))).alias("at", "chunk"))


@query("x34_category", f"{P} SELECT id, CASE id % 4 WHEN 0 THEN 'ngan_han' WHEN 1 THEN 'trung_han' WHEN 2 THEN 'dai_han' ELSE 'chung' END AS category FROM p")
def x34(spark, d):
    return bound(spark, d, PAPERS).select("id", lg.category(F.col("body"), F.instr("body", "không vượt quá") - 1).alias("category"))


@query("x35_doc_type", f"{P} SELECT id, CASE WHEN kind = 'Luật' THEN 'luat' WHEN kind = 'Nghị quyết' THEN 'nghi_quyet' WHEN number LIKE '%/TT-%' THEN 'thong_tu' WHEN number LIKE '%NQ-%' THEN 'nghi_quyet' WHEN number LIKE '%QĐ-%' THEN 'quyet_dinh' ELSE CASE WHEN number LIKE '%NĐ-CP%' THEN 'nghi_dinh' ELSE 'thong_tu' END END AS doc_type, CASE WHEN kind = 'Luật' THEN 'QH' WHEN number LIKE '%NĐ-CP%' THEN 'CP' WHEN number LIKE '%HĐTP%' THEN 'HDTP' ELSE split_part(number, '-', 2) END AS issuer FROM (SELECT id, kind, replace(number, ' ', '') AS number FROM p) q")
def x35(spark, d):
    number = F.replace("number", F.lit(" "), F.lit(""))
    typed = bound(spark, d, PAPERS).select("id", number.alias("number"), lg.doc_type(number, F.col("title")).alias("doc_type"))
    return typed.select("id", "doc_type", lg.issuer(F.col("number"), F.col("doc_type")).alias("issuer"))


@query("x37_lines", "SELECT doc_id, md5(trim(regexp_replace(replace(replace(nfc_normalize(coalesce(text, '')), chr(160), ' '), chr(8203), ''), '\\s+', ' ', 'g'))) AS digest FROM documents")
def x37(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(lg.norm_line(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query("x39_unique_title", "SELECT p_partkey, p_brand FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_name ILIKE '%COLD%' AND p_size = 24) WHERE n = 1")
def x39(spark, d):
    hits = _t(spark, d, "part").filter(F.col("p_name").ilike("%COLD%") & (F.col("p_size") == 24))
    once = hits.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).filter("n = 1")
    return once.select("p_partkey", "p_brand")


@query("x40_change_hash", "SELECT event_id, md5(concat(coalesce(event_type, ''), '|', coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END, ''))) AS digest FROM events")
def x40(spark, d):
    props = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return _t(spark, d, "events").select("event_id", F.md5(F.concat_ws("|", F.coalesce("event_type", F.lit("")), F.coalesce(props, F.lit(""))).cast("binary")).alias("digest"))


# ---------------------------------------------------------------- questions and dates

_TODAY = "1998-06-01"
_ASK = f"""{P}, q AS (SELECT id, question, {_at('question', 'ngay ([0-9]{1,2}) thang ([0-9]{1,2}) nam ([0-9]{4})')} AS d1, {_at('question', '([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})')} AS d2,
  CASE WHEN regexp_matches(question, 'thang [0-9]{{1,2}}(/| nam )[0-9]{{4}}') THEN last_day(make_date(CAST(regexp_extract(question, '[0-9]{{4}}') AS INT), CAST(regexp_extract(question, 'thang ([0-9]{{1,2}})', 1) AS INT), 1)) END AS mo,
  CASE WHEN regexp_matches(question, 'nam [0-9]{{4}}') THEN make_date(CAST(regexp_extract(question, 'nam ([0-9]{{4}})', 1) AS INT), 12, 31) END AS yr FROM p)"""


@query("m02_as_of", f"{_ASK} SELECT id, CASE WHEN question LIKE 'sap toi%' OR signed THEN DATE '{_TODAY}' ELSE CAST(coalesce(d1, d2, mo, yr, DATE '{_TODAY}') AS DATE) END AS as_of, CASE WHEN question LIKE 'sap toi%' THEN 'pending' WHEN signed OR coalesce(d1, d2) = DATE '{_TODAY}' THEN 'current' WHEN coalesce(d1, d2, mo, yr) IS NULL THEN 'current' ELSE 'point_in_time' END AS mode FROM (SELECT *, question LIKE 'khoan vay ky%' AS signed FROM q) x")
def m02(spark, d):
    # The signing date is the loan's, not the question's: it is read and cut before the time is.
    q = bound(spark, d, PAPERS).select("id", lg.as_of(lg.without_cohort(F.col("question")), F.lit(_TODAY).cast("date")).alias("a"))
    return q.select("id", "a.as_of", "a.mode")


@query("m03_signed_before", f"{_ASK} SELECT id, CASE id % 8 WHEN 6 THEN d2 WHEN 7 THEN CAST(mo + 1 AS DATE) END AS bound FROM q")
def m03(spark, d):
    return bound(spark, d, PAPERS).select("id", lg.signed_before(F.col("question")).alias("bound"))


@query("m04_epoch", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) END AS micros, last_day(CAST(ts AS DATE)) AS month_end FROM events")
def m04(spark, d):
    ts = F.when(F.col("event_id") % 5 != 0, F.col("ts")).cast("timestamp")
    return _t(spark, d, "events").select("event_id", F.coalesce(F.unix_micros(ts), F.lit(0)).alias("micros"), F.last_day("ts").alias("month_end"))


@query("m09_rates", f"{P}, r AS (SELECT id, unnest({_RATES}) AS r FROM p) SELECT id, count(*) AS n, min(CAST(replace(r, ',', '.') AS DOUBLE)) AS low, max(CAST(replace(r, ',', '.') AS DOUBLE)) AS high FROM r GROUP BY id")
def m09(spark, d):
    r = bound(spark, d, PAPERS).select("id", F.explode(lg.rates(F.col("body"))).alias("r"))
    return r.groupBy("id").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))


@query("m15_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def m15(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("m17_nonnulls", f"{OPS_WITH} SELECT op_id, CAST((valid_to IS NOT NULL)::INT + (new_text IS NOT NULL)::INT + (CASE WHEN seq > 2 THEN seq END IS NOT NULL)::INT AS INT) AS filled FROM o")
def m17(spark, d):
    given = [F.col("valid_to"), F.col("new_text"), F.when(F.col("seq") > 2, F.col("seq"))]
    return bound(spark, d, OPS).select("op_id", sum((c.isNotNull().cast("int") for c in given), F.lit(0)).alias("filled"))


# ---------------------------------------------------------------- the desk


@query("a01_due_ops", f"{OPS_WITH}, v AS (SELECT DISTINCT node_id FROM o WHERE kind = 'repeal') SELECT v.node_id, count(o.op_id) AS due FROM v LEFT JOIN o ON o.node_id = v.node_id AND o.kind = 'amend' AND o.valid_from <= DATE '1996-01-01' GROUP BY 1")
def a01(spark, d):
    o = bound(spark, d, OPS)
    ops = o.withColumn("status", F.when(F.col("kind") == "amend", "proposed").otherwise("ratified"))
    return desk.due_ops(o.filter("kind = 'repeal'").select("node_id").distinct(), ops, F.lit("1996-01-01").cast("date"))


@query("a03_tier_d", "SELECT count(*) FILTER (WHERE event_type = 'error') AS total_tier_d FROM events")
def a03(spark, d):
    return _t(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("total_tier_d"))


@query("a04_batches", "SELECT c_custkey AS batch_id, count(o_orderkey) AS ops_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a04(spark, d):
    return desk.batch_counts(_t(spark, d, "customer").select(F.col("c_custkey").alias("batch_id")), _t(spark, d, "orders").select(F.col("o_custkey").alias("batch_id")))


@query("a08_levels", f"WITH n AS ({NODES}) SELECT doc_key, count(*) FILTER (WHERE path LIKE 'dieu:%') AS dieu, count(*) FILTER (WHERE path LIKE '%/khoan:%') AS khoan, count(*) FILTER (WHERE path LIKE '%/diem:%') AS diem FROM n GROUP BY 1")
def a08(spark, d):
    level = lambda u: F.count_if(F.col("path").rlike(f"(^|/){u}:")).alias(u)
    return bound(spark, d, NODES).groupBy("doc_key").agg(level("dieu"), level("khoan"), level("diem"))


@query("a16_labels", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a16(spark, d):
    return _t(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("a19_branch_groups", f"WITH b AS ({BRANCHES}) SELECT node_id, count(DISTINCT scope_hash) AS branches FROM b WHERE valid_from <= DATE '2024-01-15' AND (valid_to IS NULL OR DATE '2024-01-15' < valid_to) GROUP BY 1 HAVING count(DISTINCT scope_hash) > 1")
def a19(spark, d):
    return desk.branch_groups(bound(spark, d, BRANCHES).filter(tp.valid_at("2024-01-15")))


@query("j07_unresolved", f"WITH n AS ({NODES}) SELECT event_id, node_id AS src_node, path, doc_key FROM events JOIN n ON node_id = concat('u', user_id) WHERE event_id % 4 = 1 AND event_type <> 'view' AND value < 50")
def j07(spark, d):
    e = bound(spark, d, "SELECT event_id, concat('u', user_id) AS src_node, CASE WHEN event_id % 4 <> 1 THEN 'x' END AS dst_node, CASE WHEN event_type = 'view' THEN 'n' END AS dst_norm, CASE WHEN value < 50 THEN NULL ELSE 'f' END AS frontier_ref FROM events")
    return desk.unresolved(e, bound(spark, d, NODES)).select("event_id", "src_node", "path", "doc_key")


@query("j09_visible_edges", f"WITH e AS (SELECT src, CASE WHEN dst LIKE '%7' THEN NULL ELSE dst END AS dst FROM ({EDGES})) SELECT DISTINCT src, dst FROM e WHERE CAST(substr(src, 2) AS BIGINT) % 3 <> 2 AND (dst IS NULL OR CAST(substr(dst, 2) AS BIGINT) % 3 <> 2)")
def j09(spark, d):
    e = bound(spark, d, EDGES).select("src", F.when(~F.col("dst").endswith("7"), F.col("dst")).alias("dst")).distinct()
    side = "SELECT concat('{0}', {1}) AS node_id, CASE {1} % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS audience FROM {2}"
    nodes = bound(spark, d, side.format("p", "p_partkey", "part")).unionByName(bound(spark, d, side.format("s", "s_suppkey", "supplier")))
    return desk.visible_edges(e, nodes, ["public", "internal"]).select("src", "dst")


@query("j12_provenance", "SELECT l_orderkey, l_linenumber, s_name AS doc_key, o_orderstatus AS approved_by FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey % 3 <> 2 LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'")
def j12(spark, d):
    ops = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_artifact"), F.col("l_orderkey").alias("batch_id"))
    src = bound(spark, d, "SELECT s_suppkey AS source_artifact, s_name AS doc_key, CASE s_nationkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS audience FROM supplier")
    signed = _t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderstatus").alias("approved_by"))
    return desk.provenance(ops, src, signed, ["public", "internal"]).select("l_orderkey", "l_linenumber", "doc_key", "approved_by")


_TWO = f"{OPS_WITH}, r AS (SELECT node_id, seq, new_text, valid_from, CAST(0.5 AS DOUBLE) AS c FROM o WHERE seq % 3 <> 0), m AS (SELECT node_id, seq, concat(new_text, '*') AS new_text, CAST(valid_from + CAST(seq % 2 AS INT) AS DATE) AS valid_from, CAST(rnk AS DOUBLE) / 4 AS c FROM o WHERE seq % 4 <> 0)"


_RULES = "SELECT l_orderkey AS doc_id, l_partkey * 1000 + l_suppkey AS seq, CASE WHEN l_returnflag = 'A' THEN 'amend' ELSE 'repeal' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN concat('dieu:', l_linenumber) END AS path, concat('Điều ', l_linenumber) AS surface, 'body' AS part, concat('r', l_partkey) AS new_text, CAST(l_shipdate AS DATE) AS valid_from, CASE WHEN l_suppkey % 3 = 0 THEN 'đến ngày sau' END AS valid_to_event, CASE WHEN l_suppkey % 4 = 0 THEN 'bank' END AS scope, l_discount AS confidence, 'rule' AS extractor, CASE WHEN l_suppkey % 5 = 0 THEN 'xem lại' END AS notes FROM lineitem WHERE l_linestatus = 'O'"
_READ = "SELECT l_orderkey AS doc_id, l_partkey * 1000 + l_suppkey AS seq, CASE WHEN l_returnflag = 'A' THEN 'amend' ELSE 'repeal' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN concat('dieu:', l_linenumber) END AS path, upper(concat('Điều ', l_linenumber)) AS surface, 'body' AS part, concat('m', l_partkey) AS new_text, CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 2 AS INT) AS DATE) AS valid_from, concat('đến ', l_partkey % 3) AS valid_to_event, 'all' AS scope, l_tax AS confidence, concat('m', l_partkey % 3) AS extractor, CASE WHEN l_partkey % 6 = 0 THEN 'target_is_amending_provision' ELSE 'khác' END AS notes FROM lineitem WHERE l_partkey % 3 > 0 OR l_linestatus = 'F'"
_KEYS = "doc_id, kind, coalesce(path, lower(surface)) AS t"


@query(
    "j22_merge",
    f"""
WITH r AS (SELECT *, {_KEYS.split(', ', 2)[2]} FROM ({_RULES}) x QUALIFY row_number() OVER (PARTITION BY {_KEYS.replace(' AS t', '')} ORDER BY seq DESC) = 1),
o AS (SELECT *, {_KEYS.split(', ', 2)[2]} FROM ({_READ}) x),
g AS (SELECT doc_id, kind, t, max(confidence) AS c, min(struct_pack(seq, new_text, valid_from, valid_to_event, extractor, notes)) AS f, string_agg(extractor, '+' ORDER BY seq, new_text, valid_from) AS e, bool_or(notes = 'target_is_amending_provision') AS amends, list(valid_from) AS days FROM o GROUP BY ALL)
SELECT doc_id, coalesce(r.seq, f.seq) AS seq, kind, t, CASE WHEN r.seq IS NULL THEN f.new_text ELSE r.new_text END AS new_text, CASE WHEN r.seq IS NULL THEN f.valid_from ELSE r.valid_from END AS valid_from,
  coalesce(r.valid_to_event, f.valid_to_event) AS valid_to_event, coalesce(r.scope, CASE WHEN c IS NOT NULL THEN 'all' END) AS scope, greatest(r.confidence, c) AS confidence,
  CASE WHEN r.seq IS NULL THEN f.extractor ELSE concat_ws('+', 'rule', e) END AS extractor, CASE WHEN r.seq IS NULL THEN f.notes WHEN amends THEN 'target_is_amending_provision' ELSE r.notes END AS notes,
  r.seq IS NOT NULL AND c IS NOT NULL AS agree, CAST(CASE WHEN r.seq IS NULL THEN 0 ELSE coalesce(len(list_filter(days, lambda x: x <> r.valid_from)), 0) END AS INTEGER) AS flags
FROM r FULL JOIN g USING (doc_id, kind, t)
""",
)
def j22(spark, d):
    m = desk.merge_extractions(bound(spark, d, _RULES), bound(spark, d, _READ))
    t = F.coalesce("path", F.lower("surface")).alias("t")
    return m.select("doc_id", "seq", "kind", t, "new_text", "valid_from", "valid_to_event", "scope", "confidence", "extractor", "notes", "agree", F.size("red_flags").alias("flags"))


@query("j26_guards", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j26(spark, d):
    o = _t(spark, d, "orders")
    return desk.unguarded(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query("l12_latest_heading", f"WITH v AS ({VERSIONS}) SELECT node_id, max_by(body, version) AS heading FROM v GROUP BY 1")
def l12(spark, d):
    return desk.latest_heading(bound(spark, d, VERSIONS).withColumnRenamed("body", "heading"))


@query("u05_touching", f"WITH e AS ({EDGES}) SELECT src, dst, 'outbound' AS direction FROM e WHERE src IN ('p1', 'p2') UNION SELECT src, dst, 'inbound' FROM e WHERE dst IN ('s1', 's2') AND src NOT IN ('p1', 'p2')")
def u05(spark, d):
    e = bound(spark, d, EDGES)
    both = e.filter("src in ('p1', 'p2')").select("src", "dst", F.lit(1).alias("k")).unionByName(e.filter("dst in ('s1', 's2')").select("src", "dst", F.lit(2).alias("k")))
    return both.groupBy("src", "dst").agg(F.when(F.min("k") == 1, "outbound").otherwise("inbound").alias("direction"))


@query("w10_norm_chain", "SELECT s_nationkey AS topic, s_suppkey AS norm_id, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS closed_by FROM supplier")
def w10(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("topic"), F.col("s_suppkey").alias("norm_id"))
    return tp.scd2(s, ["topic"], "norm_id", end="closed_by")


@query("w12_first_terms", "WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM conversations) SELECT conv_id, term, min(turn) AS turn FROM t GROUP BY 1, 2")
def w12(spark, d):
    t = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return desk.first_terms(t, "conv_id", "term", "turn")


@query("w13_repeated_lines", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type")
def w13(spark, d):
    return desk.without_repeats(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("w14_gaps", "SELECT l_orderkey, l_linenumber, expected FROM (SELECT *, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS expected FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber <> expected")
def w14(spark, d):
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return desk.sequence_gaps(items, ["l_orderkey"], "l_linenumber", "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


@query("s10_ingest", "SELECT concat('d', doc_id) AS doc_key, sha256(coalesce(text, '')) AS sha, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'same' ELSE 'conflict' END AS decision FROM documents")
def s10(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("doc_key"), F.coalesce("text", F.lit("")).alias("content"))
    held = docs.filter("doc_id % 3 <> 0").select("doc_key", F.sha2(F.concat("content", F.when(F.col("doc_id") % 3 == 2, ".").otherwise("")).cast("binary"), 256).alias("sha"))
    return desk.ingest_decision(docs, held)


@query("s14_embedding_backlog", f"WITH v AS ({VERSIONS}) SELECT node_id, version, concat(status, chr(10), body) AS text FROM v WHERE event_id % 2 = 0")
def s14(spark, d):
    v = bound(spark, d, VERSIONS).withColumn("embedding", F.when(F.col("event_id") % 2 == 1, F.lit(0.0)))
    return v.filter("embedding is null").select("node_id", "version", F.concat_ws("\n", "status", "body").alias("text"))


@query("k12_triage", "SELECT user_id AS conflict_id, max_by(event_type, (ts, event_id)) AS status, string_agg(event_type, ';' ORDER BY ts, event_id) AS reason FROM events WHERE event_type <> 'view' GROUP BY 1")
def k12(spark, d):
    e = _t(spark, d, "events").filter("event_type <> 'view'")
    log = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return e.groupBy(F.col("user_id").alias("conflict_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.array_join(F.transform(log, lambda x: x.event_type), ";").alias("reason"))


@query("k14_answer_events", "WITH e AS (SELECT conv_id * 1000 + turn AS id, role, len(string_split(text, ' ')) AS n FROM conversations) SELECT id, CAST(n + 3 AS BIGINT) AS events, CAST(n AS BIGINT) AS tokens, role AS tier FROM e")
def k14(spark, d):
    a = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", " ").alias("tokens"), F.array().cast("array<string>").alias("citations"), F.array().cast("array<string>").alias("banners"), F.col("role").alias("tier"))
    e = desk.answer_events(a)
    return e.groupBy("id").agg(F.count("*").alias("events"), F.count_if(F.col("event") == "token").alias("tokens"), F.max(F.when(F.col("event") == "tier", F.col("data"))).alias("tier"))


@query("k17_manifest", "SELECT doc_id, sha256(coalesce(text, '')) AS sha, length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents")
def k17(spark, d):
    text = F.coalesce("text", F.lit(""))
    return _t(spark, d, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha"), F.length(text).alias("chars"), F.size(F.split(text, "\n")).alias("lines"))
