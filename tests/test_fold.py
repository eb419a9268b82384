"""The fold's properties on a small operator log: windows, suspension, scope branches, errata, conflicts."""

import datetime as dt
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from chronofold.functions.temporal import coalesce_intervals, tiling_problems
from chronofold.operators import fold as fo

D = dt.date.fromisoformat
OPS = (
    "op_id string, kind string, source_artifact string, seq int, target_node string, target_op string, target_norm string, target_part string, "
    "new_text string, new_heading string, valid_from date, valid_to date, valid_to_event string, scope string, status string, superseded_by string, ingested_at timestamp"
)
ARTS = "artifact_id string, doc_key string, doc_type string, issuer string, issued_date date, effective_date date, is_oracle boolean"
NODES = "node_id string, artifact_id string, heading string, body string"

ARTIFACTS = [
    ("base", "39/2016", "thong_tu", "NHNN", D("2016-12-30"), D("2017-03-15"), False),
    ("ins", "06/2023", "thong_tu", "NHNN", D("2023-06-28"), D("2023-09-01"), False),
    ("sus", "10/2023", "thong_tu", "NHNN", D("2023-08-23"), D("2023-09-01"), False),
    ("sco", "32/2026", "thong_tu", "NHNN", D("2026-05-01"), D("2026-07-01"), False),
    ("add", "28/2026", "thong_tu", "NHNN", D("2026-01-01"), D("2026-01-15"), False),
    ("fix", "DC-01/2026", "quyet_dinh", "NHNN", D("2026-02-05"), D("2026-02-05"), False),
    ("clo", "new/2027", "thong_tu", "NHNN", D("2026-12-01"), D("2027-01-01"), False),
    ("riv", "01/2024", "thong_tu", "BTC", D("2024-01-01"), D("2024-02-01"), False),
    ("ora", "20/VBHN", "vbhn", "NHNN", D("2024-01-01"), D("2024-01-01"), True),
]
P = '{"contract_signed_before":"2026-07-01"}'


def op(op_id, kind, source, node=None, start=None, known=None, **more):
    row = dict(op_id=op_id, kind=kind, source_artifact=source, seq=1, target_node=node, target_op=None, target_norm=None, target_part="body", new_text=None, new_heading=None, valid_from=start and D(start), valid_to=None, valid_to_event=None, scope=None, status="ratified", superseded_by=None, ingested_at=dt.datetime.fromisoformat(known or "2020-01-01"))
    row.update(more)
    return tuple(row[c.split()[0]] for c in OPS.split(", "))


LOG = [
    op("i8", "insert", "ins", "n8", "2023-09-01", "2023-07-01", new_text="khoan 8", new_heading="K8"),
    op("s8", "suspend", "sus", "n8", "2023-09-01", "2023-08-25", valid_to_event="new rules"),
    op("a7", "amend", "ins", "n7", "2023-09-01", "2023-07-01", new_text="seven new"),
    op("p7", "amend", "sco", "n7", "2026-07-01", "2026-05-02", new_text="seven scoped", scope=P),
    op("i7a", "insert", "add", "n7a", "2026-01-15", "2026-01-02", new_text="07 days"),
    op("e7a", "dinh_chinh", "fix", "n7a", "2026-02-05", "2026-02-06", new_text="10 days"),
    op("r1", "amend", "ins", "n9", "2024-03-01", "2023-07-01", new_text="ours"),
    op("r2", "amend", "riv", "n9", "2024-03-01", "2024-01-02", new_text="theirs"),
    op("bl", "blanket_derogation", "ins", None, "2023-09-01", "2023-07-01"),
    op("nd", "norm_decl", "ins", None, "2023-09-01", "2023-07-01", target_norm="norm-1"),
    op("no", "amend", "ins", "n7", "2023-10-01", "2023-07-01", new_text="never", status="proposed"),
]
CLOSE = op("c8", "close_window", "clo", None, "2027-01-01", "2026-12-02", target_op="s8")


@lru_cache(maxsize=None)
def _frames(spark):
    nodes = [("n7", "base", "H7", "seven"), ("n8", "base", None, None), ("n7a", "base", None, None), ("n9", "base", "H9", "nine"), ("nx", "ora", "H", "oracle")]
    return spark.createDataFrame(nodes, NODES).cache(), spark.createDataFrame(ARTIFACTS, ARTS).cache(), fo.default_precedence(spark).cache()


@lru_cache(maxsize=None)
def _run(spark, log, known):
    nodes, artifacts, precedence = _frames(spark)
    f = fo.fold(nodes, spark.createDataFrame(list(log), OPS), artifacts, precedence, known)
    f.versions = spark.createDataFrame(f.versions.collect(), f.versions.schema)
    return f


def run(spark, log, known=None):
    return _run(spark, tuple(log), known)


def rows(versions, node):
    return [tuple(r) for r in versions.filter(F.col("node_id") == node).orderBy("version").select(F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "status", "body").collect()]


def test_suspended_from_the_start_is_never_active(spark):
    f = run(spark, LOG)
    assert rows(f.versions, "n8") == [("2023-09-01", None, "suspended", "khoan 8")]
    assert [r.op_id for r in f.pending.collect()] == ["s8"]
    assert f.versions.filter("node_id = 'n8'").first().provenance == ["i8", "s8"]
    assert [r.op_id for r in f.screening_seeds.collect()] == ["bl"]
    assert [r.norm_id for r in f.norm_events.collect()] == ["norm-1"]


def test_closing_the_suspension_and_the_known_axis(spark):
    f = run(spark, [*LOG, CLOSE])
    assert rows(f.versions, "n8") == [("2023-09-01", "2027-01-01", "suspended", "khoan 8"), ("2027-01-01", None, "active", "khoan 8")]
    assert [tuple(r) for r in f.closed.collect()] == [("s8", "c8")] and not f.pending.collect()
    early = run(spark, LOG, "2023-08-20")
    assert rows(early.versions, "n8") == [("2023-09-01", None, "active", "khoan 8")]


def test_scope_splits_into_exempt_and_complement(spark):
    v = run(spark, LOG).versions
    late = v.filter("node_id = 'n7' and valid_from = '2026-07-01'").orderBy("body").collect()
    assert [(r.body, r.scope) for r in late] == [("seven new", P), ("seven scoped", f'{{"complement_of":{P}}}')]
    assert len({r.scope_hash for r in late}) == 2


def test_errata_are_retroactive_and_keep_the_window(spark):
    v = run(spark, LOG).versions
    assert rows(v, "n7a") == [("2026-01-15", None, "active", "10 days")]
    assert v.filter("node_id = 'n7a'").first().provenance == ["i7a", "e7a"]


def test_equal_rank_and_other_issuer_is_a_certificate_without_versions(spark):
    f = run(spark, LOG)
    assert rows(f.versions, "n9") == []
    cert = f.certificates.first()
    assert cert.node_id == "n9" and sorted(cert.member_ops) == ["r1", "r2"] and cert.rank == 7
    assert not f.versions.filter("node_id = 'nx'").collect()


def test_load_order_does_not_matter(spark):
    one = {tuple(r) for r in fo.state_digest(run(spark, LOG).versions).collect()}
    other = LOG[:]
    random.Random(3).shuffle(other)
    assert {tuple(r) for r in fo.state_digest(run(spark, other).versions).collect()} == one
    changed = fo.snapshot_diff(run(spark, LOG).versions, run(spark, [*LOG, CLOSE]).versions)
    assert [tuple(r) for r in changed.collect()] == [("n8", "changed")]


def test_versions_tile(spark):
    assert tiling_problems(run(spark, [*LOG, CLOSE]).versions).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_coalesce_against_a_loop(spark, seed):
    r = random.Random(seed)
    day = lambda n: D("2020-01-01") + dt.timedelta(n)
    data = [(k, day(a := r.randint(0, 40)), None if r.random() < 0.1 else day(a + r.randint(1, 6))) for k in "abc" for _ in range(12)]
    got = sorted((x.k, x.valid_from, x.valid_to) for x in coalesce_intervals(spark.createDataFrame(data, "k string, valid_from date, valid_to date"), ["k"]).collect())
    want = []
    for k in "abc":
        merged = []
        for a, b in sorted(((a, b) for q, a, b in data if q == k), key=lambda x: (x[0], x[1] or dt.date.max)):
            if merged and (merged[-1][1] is None or merged[-1][1] >= a):
                if merged[-1][1] is not None:
                    merged[-1][1] = None if b is None else max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, a, b) for a, b in merged]
    assert got == sorted(want, key=lambda x: (x[0], x[1]))


def test_two_predicates_split_by_hand(spark):
    q = '{"entity_class":"bank"}'
    log = [op("x1", "amend", "sco", "n7", "2026-07-01", new_text="one", scope=P), op("x2", "amend", "sco", "n7", "2025-01-01", new_text="two", scope=q, seq=2)]
    v = run(spark, log).versions.filter("node_id = 'n7'")
    got = {(str(r.valid_from), r.scope, r.body) for r in v.collect()}
    assert ("2025-01-01", f'{{"complement_of":{q}}}', "two") in got and ("2025-01-01", q, "seven") in got
    assert tiling_problems(v).filter("problem = 'gap'").count() == 0


def test_operators_meet_by_node_once(spark):
    """Segments, winners, merging and errata cost no shuffle: nothing travels as often as operators are in force."""
    nodes, artifacts, precedence = _frames(spark)
    f = fo.fold(nodes, spark.createDataFrame(list(LOG), OPS), artifacts, precedence)
    for made in (f.versions, f.certificates):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_only_superseded_operators_meet_their_successors(spark):
    """Those whose successor is not known yet count; no ratified row goes through a join."""
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    log = [(f"r{i}", "ratified", "s0", day(0)) for i in range(50)] + [("s0", "superseded", "n0", day(0)), ("s1", "superseded", "n1", day(0)), ("s2", "superseded", None, day(0)), ("s3", "superseded", "n1", day(9)), ("n0", "ratified", None, day(3)), ("n1", "ratified", None, day(8)), ("p", "proposed", None, day(0))]
    got = fo.eligible_ops(spark.createDataFrame(log, "op_id string, status string, superseded_by string, ingested_at timestamp"), "2024-01-05")
    assert sorted(r.op_id for r in got.collect()) == sorted([f"r{i}" for i in range(50)] + ["n0", "s1"])

    def joined(node):
        found = [node.metrics().get("numOutputRows").get().value()] if "Join" in node.nodeName() else []
        return found + [n for k in range(node.children().size()) for n in joined(node.children().apply(k))]

    assert joined(got._jdf.queryExecution().executedPlan()) == [1]


def test_segments_are_found_once_for_versions_and_certificates(spark):
    nodes, arts, rules = _frames(spark)
    made = fo.fold(nodes, spark.createDataFrame(LOG, OPS), arts, rules)
    for part in (made.versions, made.certificates):
        assert "aggregate(" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert made.certificates.count() == 1
