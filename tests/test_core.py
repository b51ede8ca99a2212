import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from querywatch import store_queries as q
from querywatch.functions import query_text as qt
from querywatch.operators import capture, counters, identity, statistics, tracking
from querywatch.plans import flatten
from querywatch.sources.slowlog import read_slowlog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def rows(df):
    return sorted((tuple("" if x is None or x != x else round(float(x), 5) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r) for r in df), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(q.SQL[name])
    got = q.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_fair_share_never_exceeds_the_ceiling(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(3)] + [("c", i) for i in range(20)], "instance_id string, at int")
    got = {r[0]: r[1] for r in statistics.fair_share(df, 30, [F.col("at")]).groupBy("instance_id").count().collect()}
    assert sum(got.values()) <= 30 and got["b"] == 3 and got["a"] >= 10 and got["c"] >= 10


def test_rollup_residual_holds_everything_not_kept(spark):
    df = spark.createDataFrame([("i", 3600000, f"d{k:02}", 1, k * 100, 1, "incremental") for k in range(30)], "instance_id string, snapshot_ms bigint, app_digest string, count_delta bigint, time_ms bigint, rows_delta bigint, kind string")
    out = {r["app_digest"]: r for r in counters.hourly_rollup(df, 10, 100).collect()}
    assert len(out) == 11 and out["_other"]["other_digest_count"] == 20
    assert sum(r["time_ms"] for r in out.values()) == sum(k * 100 for k in range(30))
    with pytest.raises(ValueError):
        counters.hourly_rollup(df, 5, 100)


def test_merge_does_not_depend_on_order_and_passes_one_row_through(spark):
    cols = "execution_id int, started_at_ms bigint, ended_at_ms bigint, duration_ms bigint, state string, app_digest string, capture_source string"
    data = [(1, 100, 6300, 6000, "finalized", "unknown-7", "processlist"), (1, 120, None, 5200, "in_flight", "d", "slowlog"), (2, 5, 60, 7, "finalized", "x", "processlist")]
    a = rows(identity.merge_observations(spark.createDataFrame(data, cols)).collect())
    assert a == rows(identity.merge_observations(spark.createDataFrame(data[::-1], cols)).collect())
    by = {r["execution_id"]: r for r in identity.merge_observations(spark.createDataFrame(data, cols)).collect()}
    assert by[1]["duration_ms"] == 5200 and by[1]["app_digest"] == "d" and by[1]["state"] == "finalized" and by[2]["duration_ms"] == 7


MERGE = """execution_id int, started_at_ms bigint, started_at_ms_precise bigint, ended_at_ms bigint, captured_at_ms bigint, duration_ms bigint, duration_source string, state string, app_digest string, digest_algo_version int,
statement_type string, capture_source string, literal_policy string, literal_policy_at_ms bigint, sql_text string, sql_text_truncated boolean, sql_text_lossy boolean, engine_version string, db_user string, is_nested boolean, owner_epoch bigint,
stats struct<rows_examined bigint, no_index_used boolean>, plan struct<normalized_json string, s3_key string, source string, error string, referenced_tables array<string>>, lock_wait struct<observed_at_ms bigint, blocking_user string, blocking_statements array<string>>"""
SEEN = dict(
    execution_id=1, started_at_ms=0, started_at_ms_precise=None, ended_at_ms=None, captured_at_ms=0, duration_ms=0, duration_source="polled", state="in_flight", app_digest="unknown-7", digest_algo_version=1, statement_type="other",
    capture_source="processlist", literal_policy="full", literal_policy_at_ms=0, sql_text=None, sql_text_truncated=False, sql_text_lossy=False, engine_version="", db_user=None, is_nested=False, owner_epoch=0, stats=(None, None), plan=(None, None, "none", None, []), lock_wait=None)


@pytest.mark.parametrize(
    ("observed", "want"),
    [
        ([dict(duration_ms=2100, duration_source="timer"), dict(duration_ms=60000, state="finalized", ended_at_ms=62000)], dict(duration_ms=62000, duration_source="span", state="finalized", ended_at_ms=62000)),
        ([dict(duration_ms=6000, ended_at_ms=6100), dict(duration_ms=5200, duration_source="slowlog", capture_source="slowlog")], dict(duration_ms=5200, duration_source="slowlog", capture_source="merged", ended_at_ms=6100)),
        ([dict(ended_at_ms=900, started_at_ms=1000, duration_ms=5), dict(started_at_ms=1000, duration_ms=7, duration_source="timer")], dict(duration_ms=7, duration_source="timer", ended_at_ms=None)),  # an end before the start is none
        ([dict(started_at_ms_precise=400, ended_at_ms=3000), dict(started_at_ms_precise=600)], dict(duration_ms=2600, started_at_ms_precise=400)),
        ([dict(duration_ms=5, duration_source="timer"), dict(duration_ms=5)], dict(duration_ms=5, duration_source="timer")),
        ([dict(literal_policy="masked", sql_text="a = ?"), dict(literal_policy="full", literal_policy_at_ms=5, sql_text="a = 'secret'")], dict(literal_policy="masked", sql_text="a = ?", literal_policy_at_ms=0)),
        ([dict(literal_policy="full", sql_text="a = 'secret'"), dict(literal_policy="masked", sql_text=None)], dict(literal_policy="masked", sql_text=None)),  # set at one time: the stricter
        ([dict(literal_policy="off", sql_text=None, lock_wait=(5, "u", ["s"])), dict(literal_policy_at_ms=3, sql_text="x", lock_wait=(4, "v", ["t"]))], dict(literal_policy="off", sql_text=None, lock_wait=(5, "u", []))),
        ([dict(sql_text="abcd", sql_text_truncated=True), dict(sql_text="abc"), dict(sql_text="abce", sql_text_lossy=True)], dict(sql_text="abcd", sql_text_truncated=False, sql_text_lossy=False)),
        ([dict(app_digest="b", digest_algo_version=1), dict(app_digest="c", digest_algo_version=2), dict(digest_algo_version=3)], dict(app_digest="c", digest_algo_version=2)),
        ([dict(statement_type="update"), dict(statement_type="insert"), dict()], dict(statement_type="insert")),
        ([dict(stats=(5, False), engine_version="8.0", is_nested=True, owner_epoch=2), dict(stats=(None, True), engine_version="", owner_epoch=7, db_user="z")], dict(stats=(5, True), engine_version="8.0", is_nested=True, owner_epoch=7, db_user="z")),
        ([dict(plan=(None, "key", "rerun", None, ["b"])), dict(plan=(None, None, "for_connection", "denied", ["a", "b"]))], dict(plan=(None, "key", "for_connection", "denied", ["a", "b"]))),
        ([dict(plan=("{}", None, "rerun", "old", [])), dict(plan=(None, None, "rerun", "denied", []))], dict(plan=("{}", None, "rerun", None, []))),
        ([dict(duration_ms=7, ended_at_ms=-5, literal_policy="masked", sql_text="raw 1")], dict(duration_ms=7, ended_at_ms=-5, sql_text="raw 1", observations=1)),  # alone: as it is
    ],
)
def test_merge_by_hand(spark, observed, want):
    for order in (observed, observed[::-1]):
        got = identity.merge_observations(spark.createDataFrame([tuple((SEEN | o).values()) for o in order], MERGE)).first().asDict(recursive=True)
        assert {k: tuple(v.values()) if isinstance(v, dict) else v for k, v in got.items() if k in want} == want


def test_touching_runs_are_two(spark):
    cols = "event_id int, instance_id string, thread_id int, started_at_ms bigint, duration_ms bigint, app_digest string"
    one = spark.createDataFrame([(1, "i", 1, 1000, 500, "d")], cols)
    other = spark.createDataFrame([(2, "i", 1, 1500, 500, "d"), (3, "i", 1, 1499, 500, "e"), (4, "i", 2, 1000, 500, "d")], cols)
    assert identity.match_same_execution(one, other).count() == 0
    assert [tuple(r) for r in identity.match_same_execution(one, other.withColumn("app_digest", F.lit("unknown-1"))).collect()] == [(1, 3, 499)]


def test_dedupe_takes_what_the_best_row_lacks(spark):
    cols = "record_id string, event_id int, state string, capture_source string, has_plan boolean, duration_ms bigint, app_digest string, sql_text string, db_user string, rows_examined bigint, lock_wait string"
    rows_ = [("r", 1, "finalized", "merged", False, 9, "d", None, None, None, None), ("r", 2, "finalized", "slowlog", True, 5, "d", None, None, None, None), ("r", 3, "in_flight", "processlist", True, 99, "d", "text", "u", 0, "blocker")]
    got = identity.dedupe_records(spark.createDataFrame(rows_, cols)).first()
    assert (got["event_id"], got["sql_text"], got["db_user"], got["rows_examined"], got["lock_wait"], got["collapsed"]) == (2, "text", "u", None, "blocker", 2)


def test_tracking_ends_runs_only_on_complete_ticks(spark):
    obs = spark.createDataFrame([("i", 0, 1, 5, "d", "u"), ("i", 2000, 1, 7, "d", "u"), ("i", 4000, 1, 9, "d", "u")], "instance_id string, tick_ms bigint, thread_id bigint, time_secs bigint, digest string, db_user string")
    ticks = lambda cut: spark.createDataFrame([("i", t, t == 3000 and cut) for t in (0, 2000, 3000, 4000)], "instance_id string, tick_ms bigint, truncated boolean")
    assert tracking.track_executions(obs, ticks(True)).count() == 1
    assert tracking.track_executions(obs, ticks(False)).count() == 2


def test_tracking_ends_by_hand(spark):
    seen = [(1, 0, 5, None, "u"), (1, 1000, 6, "d", "u"), (1, 2000, 7, None, "u"), (1, 3000, 8, "e", "u"), (2, 0, 9, "d", "u"), (2, 1000, 1, "d", "u"), (3, 0, 1, "d", "u"), (4, 3000, 1, None, "u")]
    seen += [(9, t, t // 1000, "d", "u") for t in range(0, 7_300_000, 600_000)]
    obs = spark.createDataFrame([("i" if n < 9 else "j", t, n, s, d, u) for n, t, s, d, u in seen], "instance_id string, tick_ms bigint, thread_id bigint, time_secs bigint, digest string, db_user string")
    ticks = obs.select("instance_id", "tick_ms").distinct().withColumn("truncated", F.col("instance_id") == "j")
    got = sorted((r["thread_id"], r["started_at_ms"], r["duration_ms"], r["app_digest"] or "", r["end_reason"], r["state"]) for r in tracking.track_executions(obs, ticks).collect())
    assert got == [
        (1, -5000, 7000, "d", "thread_reused", "finalized"), (1, -5000, 8000, "e", None, "in_flight"), (2, -9000, 9000, "d", "thread_reused", "finalized"), (2, 0, 1000, "d", "disappeared", "finalized"),
        (3, -1000, 1000, "d", "disappeared", "finalized"), (4, 2000, 1000, "", None, "in_flight"), (9, 0, 4200000, "d", "too_long", "finalized"), (9, 0, 7200000, "d", None, "in_flight")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select  * from `T` where a=5 and b in (1, 2,3);", "SELECT * FROM t WHERE a = ? AND b IN ( ... )"),
        ("INSERT INTO t VALUES (1,'x'),(2,'y''z')", "INSERT INTO t VALUES ( ... )"),
        ("select /*+ no_index */ 1 -- c\n, 2", "SELECT /*+ no_index */ ? , ..."),
        ("select a <> 0x1F # x", "SELECT a != ?"),
    ],
)
def test_canonical_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(qt.canonical(F.col("t")).alias("c"))
    assert df.first()["c"] == want
    assert df.select(qt.mask_ok(F.col("c"))).first()[0]


def test_open_quote_fails_the_mask(spark):
    df = spark.createDataFrame([("select 'abc",), (None,)], "t string").select(qt.mask_ok(qt.canonical(F.col("t"))).alias("m"))
    assert [r["m"] for r in df.collect()] == [False, True]


LOG = """# Time: 2024-05-01T10:00:00.000000Z
# User@Host: app[app] @ web1 [10.0.0.1]  Id:    42
# Query_time: 2.500000  Lock_time: 0.100000 Rows_sent: 3  Rows_examined: 100
SET timestamp=1714557600;
select 'a
# Time: 2024-05-01T10:00:01.000000Z
forged' from t;
# Time: 2024-05-01T10:00:05.000000Z
# User@Host: mon[mon] @  [10.0.0.2]  Id:    43
# Query_time: 1.000000  Lock_time: 0.000000 Rows_sent: 0  Rows_examined: 0
SET timestamp=1714557605;
select 1;
# Time: 2024-05-01T10:00:06
# User@Host: app[app] @ web1 [10.0.0.1]  Id:    44
# Query_time: 1.000000  Lock_time: 0.000000 Rows_sent: 0  Rows_examined: 0
select 2;
"""


def test_slowlog_keeps_forged_headers_inside_their_statement(spark, tmp_path):
    (tmp_path / "slow.log").write_text(LOG)
    got = read_slowlog(spark, str(tmp_path / "slow.log"), 100, "mon").orderBy("thread_id").collect()
    assert [(r["thread_id"], r["reason"]) for r in got] == [(42, None), (43, "own_statement"), (44, "bad_timestamp")]
    assert "forged" in got[0]["sql_text"] and got[0]["duration_ms"] == 2500 and got[0]["started_at_ms"] == got[0]["ended_at_ms"] - 2500
    assert got[1]["db_host"] == "10.0.0.2"


def test_plan_shape_ignores_estimates(spark):
    doc = lambda rows, key: '{"query_block": {"nested_loop": [{"table": {"table_name": "a", "access_type": "ref", "key": "%s", "rows_examined_per_scan": %d}}]}}' % (key, rows)
    df = spark.createDataFrame([(1, doc(5, "k")), (2, doc(9, "k")), (3, doc(5, "z")), (4, "not json")], "plan_id int, plan_json string")
    got = {r["plan_id"]: r["fingerprint"] for r in flatten.plan_summary(flatten.parse_plans(df)).collect()}
    assert got[1] == got[2] != got[3] and 4 not in got


def test_plan_graph_links_a_node_to_its_nearest_ancestor(spark):
    doc = '{"query_block": {"table": {"table_name": "a", "materialized": {"table": {"table_name": "b"}}}}}'
    got = {r.table_name: (r.parent, r.indent) for r in flatten.plan_graph(flatten.plan_nodes(flatten.parse_plans(spark.createDataFrame([(1, doc)], "plan_id int, plan_json string")))).collect()}
    assert got == {"a": (None, 0), "b": ("a", 1)}


PLANS = {
    "nested": """{"query_block": {"cost_info": {"query_cost": "77.50"}, "ordering_operation": {"using_filesort": true, "nested_loop": [
        {"table": {"table_name": "o", "access_type": "ALL", "rows_examined_per_scan": 5000, "filtered": "3.30", "attached_condition": "(`crm`.`o`.`id` = 7)", "cost_info": {"prefix_cost": "90.00"}}},
        {"table": {"table_name": "<derived2>", "access_type": "ALL", "materialized_from_subquery": {"using_temporary_table": "TRUE", "query_block": {"cost_info": {"query_cost": 200}, "table":
            {"table_name": "s", "access_type": "system", "using_filesort": true}}}}}]}}}""",
    "second": """{"query": "select 1", "inputs": [{"operation": "Sort", "estimated_total_cost": 4.5, "inputs": [{"table_name": "b", "access_type": "index", "key": "k", "possible_keys": "k", "used_key_parts": ["x", 3, "y"], "rows_examined_per_scan": "-2.5"}]}]}""",
    "tableless": '{"query_plan": {"estimated_total_cost": "3"}}', "other": '{"a": {"table_name": null}}', "list": "[]", "none": '{"a": 1}', "broken": "{", "void": None,
}


def test_plans_by_hand(spark):
    df = flatten.parse_plans(spark.createDataFrame(list(PLANS.items()), "plan_id string, plan_json string"))
    got = {r["plan_id"]: r for r in flatten.plan_summary(df, "shop").collect()}
    assert {k: (r["format"], r["nodes"], r["max_rows_examined"], r["cost"], r["tables"]) for k, r in got.items()} == {
        "nested": ("v1", 3, 5000, 77.5, "crm.o,shop.s"), "second": ("v2", 1, 0, 4.5, "shop.b"), "tableless": ("v2", 0, None, 3.0, ""), "other": ("unknown", 1, None, None, "")}
    shape = "4|table|o|ALL|-|\n4|table|<derived2>|ALL|-|\n7|table|s|system|-||fs\n"
    assert got["nested"]["fingerprint"] == hashlib.sha256(shape.encode()).hexdigest()[:16]
    assert got["second"]["fingerprint"] == hashlib.sha256(b"2|inputs|b|index|k|x,y\n").hexdigest()[:16]
    warned = sorted((r["plan_id"], r["table_name"] or "", r["warning"]) for r in flatten.plan_warnings(df).collect())
    assert warned == [("nested", "", "filesort"), ("nested", "", "temporary_table"), ("nested", "o", "full_scan"), ("nested", "o", "low_filtered"), ("nested", "o", "no_index"), ("nested", "o", "no_possible_keys"), ("second", "b", "full_index_scan")]
    graph = {r["table_name"]: r["parent"] for r in flatten.plan_graph(flatten.plan_nodes(df)).filter("plan_id = 'nested'").collect()}
    assert graph == {"o": None, "<derived2>": None, "s": "<derived2>"}


def test_stored_sql_degrades_to_none(spark):
    df = spark.createDataFrame([("masked", "c", False), ("masked", "c", True), ("off", "c", True), ("full", "c", False)], "literal_policy string, canonical string, mask_ok boolean").withColumn("sql_text", F.lit("t"))
    assert [(r.stored_sql, r.masking_degraded) for r in capture.stored_sql(df).collect()] == [(None, True), ("c", False), (None, False), ("t", False)]


def folded(data):
    """Plain model: greedy scan of each thread against all kept rows within 2000 ms."""
    rank = lambda r: ({"finalized": 2, "abandoned": 1}.get(r[6], 0), r[7] in ("slowlog", "merged"), r[4])
    unknown = lambda d: d is None or d.startswith("unknown-")
    out = []
    for key in {r[1:3] for r in data}:
        kept = []
        for r in sorted((r for r in data if r[1:3] == key), key=lambda r: (r[3], r[0])):
            for k in kept:
                x = k[0]
                near = r[3] - x[3] <= 2000 and abs(r[3] - x[3]) <= 1000
                if near and (r[5] == x[5] or unknown(r[5]) or unknown(x[5])) and r[3] < x[3] + x[4] and x[3] < r[3] + r[4]:
                    k[0] = x if rank(x) >= rank(r) else r
                    k[1] += 1
                    break
            else:
                kept.append([r, 0])
        out += [(x[1], x[2], x[0], n) for x, n in kept]
    return sorted(out)


TWINS = "event_id bigint, instance_id string, thread_id bigint, started_at_ms bigint, duration_ms bigint, app_digest string, state string, capture_source string"


def collapsed(spark, data):
    return sorted(tuple(r) for r in identity.collapse_twins(spark.createDataFrame(data, TWINS)).select("instance_id", "thread_id", "event_id", "collapsed").collect())


def test_twins_meet_across_a_record_between_and_chains_do_not_grow(spark):
    between = [(1, "i", 1, 0, 5000, "d", "finalized", "slowlog"), (2, "i", 1, 200, 50, "other", "finalized", "slowlog"), (3, "i", 1, 400, 5000, "d", "in_flight", "processlist")]
    chain = [(n, "i", 2, 800 * n, 5000, "d", "finalized", "slowlog") for n in (4, 5, 6)]
    assert collapsed(spark, between + chain) == [("i", 1, 1, 1), ("i", 1, 2, 0), ("i", 2, 4, 1), ("i", 2, 6, 0)]


def test_twins_equal_the_plain_model(spark):
    import random

    r = random.Random(4)
    data = []
    for n in range(3000):  # one thread is dense: its only piece spans many batches' windows
        thread = r.choice((1, 1, 2, 3, 4))
        at = r.randrange(0, 40_000 if thread == 1 else 900_000)
        data.append((n, r.choice("ij"), thread, at, r.choice((0, 40, 700, 3000)), r.choice(("a", "b", "c", "unknown-7", None)), r.choice(("finalized", "abandoned", "in_flight")), r.choice(("slowlog", "processlist", "merged"))))
    assert collapsed(spark, data) == folded(data)


def test_merging_deals_rows_once(spark):
    cols = "execution_id int, started_at_ms bigint, ended_at_ms bigint, duration_ms bigint, state string, app_digest string, capture_source string"
    sources = {1: ["slowlog", "processlist"], 2: ["slowlog", "slowlog"], 3: ["slowlog", None], 4: [None, None], 5: [None]}
    df = spark.createDataFrame([(k, 1, 2, 1, "finalized", "d", s) for k, v in sources.items() for s in v], cols)
    merged = identity.merge_observations(df)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.execution_id: r.capture_source for r in merged.collect()} == {1: "merged", 2: "slowlog", 3: "slowlog", 4: None, 5: None}
