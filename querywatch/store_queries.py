"""More registered queries: capture, store, inventory, series and plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from querywatch.functions import query_text
from querywatch.operators import capture, counters, inventory, locks, statistics
from querywatch.plans import flatten, mask
from querywatch.queries import KEYS_SQL, PLANS_SQL, POINTS_SQL, QUERIES, SQL, TO_MS, TWINS_SQL, metadata_locks, plan_documents, points, query, twins, with_executions
from querywatch.sources import slowlog, store
from querywatch.sources.views import executions, table
from querywatch.streaming import feed

DAY = store.DAY_MS


def snapshots(spark, sf_dir):
    e = executions(spark, sf_dir)
    return e.select(
        "event_id", "instance_id", (F.floor(F.col("started_at_ms") / 3600000) * 3600000).alias("tick_ms"), F.col("event_id").alias("thread_id"), F.when(F.col("statement_type") == "other", "Sleep").otherwise("Query").alias("command"),
        F.floor(F.col("duration_ms") / 1000).alias("time_secs"), F.when(F.col("event_id") % 9 == 0, "sys").when(F.col("event_id") % 2 == 0, "shop").alias("schema_name"), "db_user")


@query("a3_read_processlist", with_executions("""
, s AS (SELECT event_id, instance_id, started_at_ms // 3600000 * 3600000 AS tick_ms, event_id AS thread_id, duration_ms // 1000 AS time_secs FROM executions
 WHERE statement_type <> 'other' AND duration_ms // 1000 >= 2 AND event_id % 9 <> 0 AND coalesce(db_user, '') <> 'u3')
SELECT event_id, instance_id, tick_ms, time_secs, count(*) OVER (PARTITION BY instance_id, tick_ms) > 5 AS truncated FROM s
QUALIFY row_number() OVER (PARTITION BY instance_id, tick_ms ORDER BY time_secs DESC, thread_id) <= 5"""))  # fmt: skip
def a3(spark, sf_dir):
    return capture.read_processlist(snapshots(spark, sf_dir), 2, ["sys"], ["u3"], 5).select("event_id", "instance_id", "tick_ms", "time_secs", "truncated")


@query("a2_resume_window", with_executions(f"""
, c AS (SELECT 'inst-' || n_nationkey AS instance_id, (SELECT max(started_at_ms) FROM executions e WHERE e.instance_id = 'inst-' || n_nationkey) AS checkpoint_ms FROM nation)
SELECT instance_id, checkpoint_ms, CASE WHEN checkpoint_ms IS NULL THEN {TO_MS + 12 * DAY} - 3600000 ELSE greatest(checkpoint_ms, {TO_MS + 12 * DAY - 3600000 * 6}) END AS from_ms,
 greatest(coalesce({TO_MS + 12 * DAY - 3600000 * 6} - checkpoint_ms, 0), 0) AS skipped_ms FROM c"""))  # fmt: skip
def a2(spark, sf_dir):
    seen = executions(spark, sf_dir).groupBy("instance_id").agg(F.max("started_at_ms").alias("checkpoint_ms"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("inst-"), F.col("n_nationkey").cast("string")).alias("instance_id"))
    return store.resume_window(known.join(seen, "instance_id", "left"), TO_MS + 12 * DAY, 3_600_000, 6 * 3_600_000)


@query("a4_read_status", with_executions("""
SELECT instance_id, started_at_ms // 60000 * 60000 AS at_ms, max(CASE WHEN event_id % 3 = 0 THEN CAST(rows_examined AS DOUBLE) END) AS questions, max(CASE WHEN event_id % 3 = 1 THEN CAST(lock_time_ms AS DOUBLE) END) AS threads_running
FROM executions GROUP BY 1, 2"""))  # fmt: skip
def a4(spark, sf_dir):
    e = executions(spark, sf_dir).withColumn("at_ms", F.floor(F.col("started_at_ms") / 60000) * 60000)
    status = e.select("instance_id", "at_ms", F.when(F.col("event_id") % 3 == 0, "Questions").otherwise("other").alias("variable_name"), F.col("rows_examined").cast("string").alias("variable_value"))
    running = e.select("instance_id", "at_ms", F.when(F.col("event_id") % 3 == 1, "THREADS_RUNNING").otherwise("other").alias("variable_name"), F.col("lock_time_ms").cast("string").alias("variable_value"))
    return store.read_status([status, running], ["questions", "threads_running"])


@query("a5_read_digest_snapshots", with_executions(f"""SELECT event_id, started_at_ms AS last_seen_ms FROM executions WHERE started_at_ms >= {TO_MS} - 5000 AND event_id % 9 <> 0"""))
def a5(spark, sf_dir):
    e = executions(spark, sf_dir).select("event_id", F.col("started_at_ms").alias("last_seen_ms"), F.when(F.col("event_id") % 9 == 0, "SYS").alias("schema_name"))
    return store.read_digest_snapshots(e, TO_MS).drop("schema_name")


#: A record of each (day, instance, record_id) of the twins, as D7 merges them.
MERGED_SQL = f"""WITH {TWINS_SQL}, k AS (SELECT *, instance_id || ':' || thread_id || ':' || (started_at_ms // 1000) AS record_id, strftime(make_timestamp(started_at_ms * 1000), '%Y-%m-%d') AS date_part,
 CASE WHEN state = 'finalized' THEN started_at_ms + duration_ms - 20 END AS ended, event_id % 3 = 0 AS measured FROM twins),
m AS (SELECT date_part, instance_id, record_id, count(*) AS observations, min(started_at_ms) AS started_at_ms, max(ended) AS any_end, max(ended) FILTER (WHERE ended >= started_at_ms) AS valid_end, max(duration_ms) AS longest,
 max(duration_ms) FILTER (WHERE capture_source = 'slowlog') AS exact, CASE WHEN bool_or(state = 'finalized') THEN 'finalized' ELSE 'in_flight' END AS state, coalesce(min(app_digest) FILTER (WHERE NOT starts_with(app_digest, 'unknown-')), min(app_digest)) AS app_digest,
 CASE WHEN count(DISTINCT capture_source) > 1 THEN 'merged' ELSE min(capture_source) END AS capture_source, min(db_user) AS db_user, max(rows_examined) FILTER (WHERE measured) AS rows_examined FROM k GROUP BY 1, 2, 3)
SELECT date_part, instance_id, record_id, observations, started_at_ms, CASE WHEN observations = 1 THEN any_end ELSE valid_end END AS ended_at_ms, CASE WHEN observations = 1 THEN longest ELSE coalesce(exact, valid_end - started_at_ms, longest) END AS duration_ms,
 state, app_digest, capture_source, db_user, rows_examined FROM m"""


def scratch(spark, name):
    base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def observed(spark, sf_dir):
    """Twins as observations of records."""
    rows = statistics.derive_keys(twins(spark, sf_dir))
    return rows.withColumns({
        "ended_at_ms": F.when(F.col("state") == "finalized", F.col("started_at_ms") + F.col("duration_ms") - 20), "stats": F.struct(F.when(F.col("event_id") % 3 == 0, F.col("rows_examined")).alias("rows_examined")),
        "captured_at_ms": F.col("started_at_ms")}).select("event_id", "date_part", "instance_id", "record_id", "thread_id", "started_at_ms", "ended_at_ms", "captured_at_ms", "duration_ms", "state", "app_digest", "capture_source", "db_user", "stats")


MERGED = ("date_part", "instance_id", "record_id", "observations", "started_at_ms", "ended_at_ms", "duration_ms", "state", "app_digest", "capture_source", "db_user", "stats.rows_examined")


@query("a7_write_executions", MERGED_SQL)
def a7(spark, sf_dir):
    """The late twins first, the others in two writes, one of them twice."""
    path, rows = scratch(spark, "executions"), observed(spark, sf_dir)
    late, odd = F.col("event_id") >= 1_000_000_000, F.col("event_id") % 2 == 1
    for batch, part in ((0, rows.filter(late)), (1, rows.filter(~late & odd)), (2, rows.filter(~late & ~odd)), (1, rows.filter(~late & odd))):
        stored = store.write_executions(part.drop("event_id"), path, batch)
    return stored.select(*MERGED)


@query("a8_apply_retention", with_executions(f"SELECT event_id FROM executions WHERE started_at_ms > {TO_MS - 10 * DAY}"))
def a8(spark, sf_dir):
    return store.apply_retention(statistics.derive_keys(executions(spark, sf_dir)), TO_MS + 25 * DAY).select("event_id")


@query("a9_route_tier", with_executions(f"SELECT event_id, CASE WHEN started_at_ms >= {TO_MS - 5 * DAY} THEN 'hot' ELSE 'cold' END AS tier FROM executions WHERE started_at_ms BETWEEN {TO_MS - 9 * DAY} AND {TO_MS}"))
def a9(spark, sf_dir):
    e = executions(spark, sf_dir)
    return store.route_tier(e, e, TO_MS - 9 * DAY, TO_MS, TO_MS - 5 * DAY).select("event_id", "tier")


@query("a6_read_metric_series", POINTS_SQL + "SELECT * FROM points")
def a6(spark, sf_dir):
    p = points(spark, sf_dir).groupBy("instance_id", "metric", F.floor(F.col("at_ms") / 86400000)).agg(F.collect_list(F.struct("at_ms", "value")).alias("p"))  # a page is a day
    return counters.read_metric_series(p.select("instance_id", "metric", F.col("p.at_ms").alias("timestamps_ms"), F.col("p.value").alias("values")))


INDEXES_SQL = "WITH x AS (SELECT DISTINCT 't' || l_suppkey AS table_name, 'k' || l_returnflag AS index_name, l_linenumber AS seq, 'c' || l_linenumber % 3 AS column_name FROM lineitem), i AS (SELECT table_name, index_name, string_agg(column_name, ',' ORDER BY seq) AS c FROM x GROUP BY 1, 2)"


def index_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("table_name"), F.concat(F.lit("k"), "l_returnflag").alias("index_name"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("c"), (F.col("l_linenumber") % 3).cast("string")).alias("column_name")).distinct()


@query("a10_assemble_table_specs", INDEXES_SQL + "SELECT table_name, string_agg(index_name || '=' || c, ';' ORDER BY index_name) AS indexes FROM i GROUP BY 1")
def a10(spark, sf_dir):
    shown = F.transform("indexes", lambda i: F.concat(i["index_name"], F.lit("="), F.array_join(i["columns"], ",")))
    return inventory.assemble_table_specs(index_columns(spark, sf_dir)).select("table_name", F.array_join(shown, ";").alias("indexes"))


@query("d17_schema_fingerprint", INDEXES_SQL + "SELECT table_name, sha256(string_agg(index_name || '(' || c || ')', chr(10) ORDER BY index_name || '(' || c || ')')) AS fingerprint FROM i GROUP BY 1")
def d17(spark, sf_dir):
    return inventory.schema_fingerprint(inventory.assemble_table_specs(index_columns(spark, sf_dir)))


@query("b7_with_plan", with_executions(f"SELECT event_id, order_key FROM ({KEYS_SQL}) WHERE event_id % 3 = 0 ORDER BY order_key DESC, instance_id LIMIT 500"))
def b7(spark, sf_dir):
    return capture.with_plan(statistics.derive_keys(executions(spark, sf_dir)).withColumn("has_plan", F.col("event_id") % 3 == 0)).select("event_id", "order_key")


def customers(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_name").alias("name"), F.element_at(F.array(F.lit("prod"), F.lit("stage"), F.lit("dev"), F.lit("qa")), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("env"), (k % 6 != 0).alias("live"),
        F.concat_ws(".", (k % 3 + 6).cast("string"), (k % 2).cast("string"), (k % 40).cast("string")).alias("version"), F.when(k % 10 != 0, F.col("c_name")).alias("endpoint"), F.concat(F.lit("vpc-"), (k % 3).cast("string")).alias("vpc_id"),
        F.when(k % 7 == 0, " Stopped").otherwise("available").alias("status"), F.create_map(F.when(k % 8 == 0, "OWNER").otherwise("Collect"), F.when(k % 5 == 0, " False").otherwise("yes")).alias("tags"))


CUSTOMERS_SQL = """WITH c AS (SELECT *, c_custkey AS id, ['prod', 'stage', 'dev', 'qa'][c_nationkey % 4 + 1] AS env, c_custkey % 3 + 6 AS major, c_custkey % 40 AS patch, c_custkey % 2 AS minor FROM customer),
i AS (SELECT *, (major > 8 OR (major = 8 AND (minor > 0 OR patch >= 11))) AS supported FROM c)"""


@query("b14_supported", CUSTOMERS_SQL + "SELECT id, major, minor, patch, supported FROM i")
def b14(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("v", inventory.parse_version(F.col("version")))
    return c.select("id", *[F.col(f"v.{n}").cast("bigint").alias(n) for n in ("major", "minor", "patch")], inventory.supported(F.col("v"), (8, 0, 11)).alias("supported"))


@query("b15_initial_state", CUSTOMERS_SQL + "SELECT id, CASE WHEN id % 8 <> 0 AND id % 5 = 0 THEN 'disabled' WHEN NOT supported THEN 'unsupported' WHEN id % 7 = 0 THEN 'unreachable' ELSE 'pending' END AS state FROM i")
def b15(spark, sf_dir):
    return inventory.initial_state(customers(spark, sf_dir), "collect", (8, 0, 11)).select("id", "state")


@query("b8_discovery_verdict", CUSTOMERS_SQL + "SELECT id, CASE WHEN id % 3 = 2 THEN 'vpc' WHEN id % 8 = 0 THEN 'required_tag' WHEN suffix(c_name, '7') THEN 'denied_name' ELSE 'accepted' END AS verdict FROM i")
def b8(spark, sf_dir):
    return inventory.discovery_verdict(customers(spark, sf_dir), ["vpc-0", "vpc-1"], ["COLLECT"], "7$").select("id", "verdict")


@query("b9_collectible", CUSTOMERS_SQL + "SELECT id, env FROM i WHERE supported AND id % 6 <> 0 AND id % 10 <> 0 AND env <> 'dev' AND id NOT IN (SELECT s_suppkey FROM supplier)")
def b9(spark, sf_dir):
    c = customers(spark, sf_dir)
    c = c.withColumn("supported", inventory.supported(inventory.parse_version(F.col("version")), (8, 0, 11)))
    pauses = table(spark, sf_dir, "supplier").select(F.concat(F.lit("id:"), F.col("s_suppkey").cast("string")).alias("scope"))
    pauses = pauses.unionByName(table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("env:dev").alias("scope")))
    return inventory.collectible(c, pauses).select("id", "env")


@query("b10_drop_own", with_executions("SELECT event_id FROM executions WHERE coalesce(db_user, '') <> 'u3' AND NOT starts_with(coalesce(sql_text, ''), 'SELECT view')"))
def b10(spark, sf_dir):
    return capture.drop_own(executions(spark, sf_dir), "u3", "SELECT view").select("event_id")


GATE_SQL = "SELECT event_id, CASE WHEN sql_text IS NULL THEN 'empty_sql' WHEN duration_ms < 2000 THEN 'below_threshold' END AS skip_reason FROM executions"


@query("b11_quality_gate", with_executions(GATE_SQL))
def b11(spark, sf_dir):
    return capture.quality_gate(executions(spark, sf_dir), 2000).select("event_id", "skip_reason")


@query("d11_skip_report", with_executions(f"SELECT coalesce(skip_reason, 'accepted') AS reason, count(*) AS n FROM ({GATE_SQL}) GROUP BY 1"))
def d11(spark, sf_dir):
    return capture.skip_report(b11(spark, sf_dir))


@query("b16_metric_severity", CUSTOMERS_SQL + """, s AS (SELECT id, CASE WHEN id % 9 <> 0 THEN id % 101 END AS cpu, (id * 7 % 100) * 100.0 / 120 AS cs, CASE WHEN id % 4 <> 0 THEN (id % 50) * 100.0 / 100 END AS st FROM i)
SELECT id, CASE WHEN cpu >= 85 THEN 'alarm' WHEN cpu >= 70 THEN 'warn' WHEN cpu IS NOT NULL THEN 'ok' END AS cpu_severity, CASE WHEN cs >= 85 THEN 'alarm' WHEN cs >= 70 THEN 'warn' ELSE 'ok' END AS connections_severity,
 CASE WHEN st <= 10 THEN 'alarm' WHEN st <= 20 THEN 'warn' WHEN st IS NOT NULL THEN 'ok' END AS storage_left_severity FROM s""")  # fmt: skip
def b16(spark, sf_dir):
    k = F.col("id")
    rows = customers(spark, sf_dir).select("id", F.when(k % 9 != 0, k % 101).alias("cpu"), (k * 7 % 100).alias("connections"), F.lit(120).alias("max_connections"), (k % 50).alias("storage_left"), F.when(k % 4 != 0, 100).otherwise(0).alias("storage"))
    return counters.metric_severity(rows).select("id", "cpu_severity", "connections_severity", "storage_left_severity")


@query("b19_final_counters_only", with_executions("SELECT event_id, CASE WHEN state = 'finalized' THEN rows_examined END AS rows_examined, CASE WHEN state = 'finalized' THEN lock_time_ms END AS lock_time_ms FROM executions"))
def b19(spark, sf_dir):
    e = executions(spark, sf_dir).withColumn("end_event_id", F.when(F.col("state") == "finalized", F.col("event_id")))
    return capture.final_counters_only(e, ["rows_examined", "lock_time_ms"]).select("event_id", "rows_examined", "lock_time_ms")


@query("b20_pick_sql_text", with_executions("""SELECT event_id, coalesce(sql_text, CASE WHEN event_id % 3 = 0 THEN 'SELECT' END) AS sql_text, CASE WHEN sql_text IS NOT NULL THEN event_id % 3 <> 0 WHEN event_id % 3 = 0 THEN false END AS sql_text_truncated,
 CASE WHEN sql_text IS NOT NULL THEN false WHEN event_id % 3 = 0 THEN true END AS sql_text_lossy FROM executions"""))  # fmt: skip
def b20(spark, sf_dir):
    e = executions(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, "SELECT").alias("list_text"), F.col("sql_text").alias("history_text"))
    return capture.pick_sql_text(e).select("event_id", "sql_text", "sql_text_truncated", "sql_text_lossy")


@query("c2_pick_target", f"""WITH {TWINS_SQL}, k AS (SELECT *, lpad(CAST(started_at_ms AS VARCHAR), 13, '0') || '#' || thread_id AS order_key FROM twins),
p AS (SELECT a.event_id AS incoming_id, b.event_id AS candidate_id, abs(a.started_at_ms - b.started_at_ms) AS apart, b.order_key <> a.order_key AS other, a.state <> 'in_flight' AND b.state <> 'in_flight' AS closed, b.order_key AS bk
 FROM k a JOIN k b ON a.instance_id = b.instance_id AND a.thread_id = b.thread_id AND a.event_id < 1000000000 AND b.event_id >= 1000000000 AND abs(a.started_at_ms - b.started_at_ms) <= 2000)
SELECT incoming_id, arg_min(candidate_id, (CAST(closed AS INT), CAST(other AS INT), CAST(apart <> 0 AS INT), apart, bk, candidate_id)) AS candidate_id, count(*) AS candidates FROM p GROUP BY 1""")  # fmt: skip
def c2(spark, sf_dir):
    t = statistics.derive_keys(twins(spark, sf_dir)).withColumn("slot", F.floor(F.col("started_at_ms") / 2000))
    a = t.filter("event_id < 1000000000").select("instance_id", "thread_id", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"), F.col("event_id").alias("incoming_id"),
                                                 F.col("state").alias("incoming_state"), F.col("started_at_ms").alias("incoming_start_ms"), F.col("order_key").alias("incoming_key"))
    b = t.filter("event_id >= 1000000000").select("instance_id", "thread_id", "slot", F.col("event_id").alias("candidate_id"), "state", "started_at_ms", "order_key")
    return capture.pick_target(a.join(b, ["instance_id", "thread_id", "slot"]).filter("abs(started_at_ms - incoming_start_ms) <= 2000"))


@query("c4_transaction_statements", """SELECT o_custkey AS thread_id, o_orderkey AS transaction_id, string_agg('s' || l_partkey, '; ' ORDER BY l_linenumber, 's' || l_partkey) AS statements, count(*) AS n
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1, 2""")  # fmt: skip
def c4(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    open_ = orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("thread_id"), F.col("o_orderkey").alias("transaction_id"))
    owner = orders.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("thread_id"))
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("statement_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("sql_text")).join(owner, "transaction_id")
    return locks.transaction_statements(open_, said)


@query("c5_open_transactions", """SELECT o_orderkey AS transaction_id, o_orderkey % 5000 AS age_s, c_name AS user, c_nationkey IS NULL OR c_nationkey = 0 AS idle FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O' AND o_orderkey % 5000 >= 60 ORDER BY age_s DESC, transaction_id LIMIT 100""")  # fmt: skip
def c5(spark, sf_dir):
    t = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("thread_id"), (F.col("o_orderkey") % 5000).alias("age_s"))
    threads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread_id"), F.col("c_name").alias("user"), F.col("c_nationkey").alias("time_s"))
    return locks.open_transactions(t, threads, 60, 100).select("transaction_id", "age_s", "user", "idle")


@query("c7_attach_statement_metrics", f"""WITH {TWINS_SQL}, h AS (SELECT instance_id, thread_id, app_digest, arg_max(rows_examined, event_id) AS r, arg_max(lock_time_ms, event_id) AS l FROM executions WHERE capture_source = 'slowlog' AND state = 'finalized' GROUP BY 1, 2, 3)
SELECT event_id, r AS history_rows_examined, l AS history_lock_time_ms FROM twins LEFT JOIN h USING (instance_id, thread_id, app_digest)""")  # fmt: skip
def c7(spark, sf_dir):
    e = executions(spark, sf_dir).filter("capture_source = 'slowlog'")
    history = e.select("instance_id", "thread_id", "app_digest", F.col("event_id").alias("history_id"), F.when(F.col("state") == "finalized", F.col("event_id")).alias("end_event_id"), "rows_examined", "lock_time_ms")
    rows = twins(spark, sf_dir).select("event_id", "instance_id", "thread_id", "app_digest")
    return capture.attach_statement_metrics(rows, history, ["rows_examined", "lock_time_ms"]).select("event_id", "history_rows_examined", "history_lock_time_ms")


@query("c9_fleet_table", POINTS_SQL + """, v AS (SELECT instance_id AS key, metric, max(at_ms) AS at_ms, arg_max(value, at_ms) AS value FROM points GROUP BY 1, 2), i AS (SELECT 'inst-' || n_nationkey AS instance_id, 'inst-' || n_nationkey % 3 AS cluster_id FROM nation),
c AS (SELECT DISTINCT metric, metric = 'purchase' AS whole FROM points)
SELECT i.instance_id, c.metric, v.at_ms, v.value FROM i CROSS JOIN c LEFT JOIN v ON v.metric = c.metric AND v.key = CASE WHEN whole THEN cluster_id ELSE i.instance_id END""")  # fmt: skip
def c9(spark, sf_dir):
    n = F.col("n_nationkey")
    instances = table(spark, sf_dir, "nation").select(F.concat(F.lit("inst-"), n.cast("string")).alias("instance_id"), F.concat(F.lit("inst-"), (n % 3).cast("string")).alias("cluster_id"))
    p = points(spark, sf_dir)
    catalog = p.select("metric").distinct().withColumn("scope", F.when(F.col("metric") == "purchase", "cluster").otherwise("instance"))
    return inventory.fleet_table(instances, catalog, counters.latest_value(p))


@query("c10_resolve_tables", """SELECT o_orderkey AS plan_id, array_to_string(list_sort([x FOR x IN [CASE o_orderkey % 3 WHEN 0 THEN 'crm.lineitem' WHEN 1 THEN 'shop.items' ELSE 'shop.lineitem' END,
 CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'old.orders' ELSE 'own.orders' END WHEN o_orderkey % 5 = 0 THEN 'old.orders' ELSE 'shop.orders' END, CASE WHEN o_orderkey % 4 = 3 THEN 'shop.region' END] IF x IS NOT NULL]), ',') AS tables FROM orders""")  # fmt: skip
def c10(spark, sf_dir):
    """References by alias, by name, behind another alias (no match), twice (the first counts), and names that bring their own schema."""
    docs, k = plan_documents(spark, sf_dir), F.col("plan_id")
    ref = lambda n, schema, name, alias: F.struct(F.lit(n).alias("position"), schema.alias("schema_name"), name.alias("table_name"), alias.alias("alias"))
    lit, none = F.lit, F.lit(None).cast("string")
    items = ref(1, F.when(k % 3 != 1, "crm"), F.when(k % 3 == 1, "items").otherwise("lineitem"), F.when(k % 3 == 1, "lineitem").when(k % 3 == 2, "li"))
    orders = F.when(k % 5 == 0, ref(2, lit("old"), lit("orders"), none))
    refs = docs.select("plan_id", F.explode(F.array_compact(F.array(ref(3, lit("x"), F.when(k % 3 != 2, "lineitem").otherwise("t"), none), items, orders))).alias("r")).select("plan_id", "r.*")
    nodes = flatten.plan_nodes(flatten.parse_plans(docs)).filter(flatten.real_table(F.col("table_name")))
    shown = F.when((F.col("table_name") == "orders") & (k % 7 == 0), "own.orders").otherwise(F.col("table_name"))
    return flatten.resolve_tables(nodes.select("plan_id", shown.alias("table_name")), refs, "shop")


@query("d11b_tick_report", with_executions(f"""SELECT instance_id, started_at_ms // 86400000 AS tick_ms, count(*) AS candidates, count(*) FILTER (WHERE event_id % 2 = 0) AS probed, count(*) FILTER (WHERE event_id % 2 = 1) AS probes_skipped, count(*) FILTER (WHERE state = 'finalized') AS finalized,
 count(*) FILTER (WHERE state = 'finalized' AND capture_source = 'slowlog') AS with_history, count(*) FILTER (WHERE event_id % 5 = 0) AS plans_for_connection, count(*) FILTER (WHERE event_id % 5 = 1) AS plans_rerun, count(*) FILTER (WHERE event_id % 5 = 2) AS plans_rerun_as_select,
 count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 = 3) AS plans_failed, count(*) FILTER (WHERE literal_policy = 'masked' AND event_id % 7 = 0) AS masking_degraded, count(*) FILTER (WHERE event_id % 50 = 1) AS evicted, bool_or(event_id % 40 = 0) AS truncated FROM executions GROUP BY 1, 2"""))  # fmt: skip
def d11b(spark, sf_dir):
    k, e = F.col("event_id"), executions(spark, sf_dir)
    sources = F.get(F.array(*map(F.lit, ("for_connection", "rerun", "rerun_as_select", "none"))), (k % 5).cast("int"))  # null for the fifth
    return capture.tick_report(e.select(
        "instance_id", F.floor(F.col("started_at_ms") / DAY).alias("tick_ms"), (k % 2 == 0).alias("probed"), (k % 3 != 0).alias("wants_plan"), "state", (F.col("capture_source") == "slowlog").alias("has_history"), sources.alias("plan_source"),
        ((F.col("literal_policy") == "masked") & (k % 7 == 0)).alias("masking_degraded"), F.when(k % 50 == 1, "evicted").alias("end_reason"), (k % 40 == 0).alias("truncated")))


@query("i6_close_paused", with_executions(f""", p AS (SELECT env, CASE env WHEN 'dev' THEN {TO_MS - 9 * DAY} END AS since FROM (SELECT DISTINCT env FROM executions)), q AS (SELECT 'inst-' || n_nationkey AS instance_id, {TO_MS} - n_nationkey * {DAY} AS since FROM nation WHERE n_nationkey % 3 = 0)
SELECT event_id, 'abandoned' AS state, 'collector_paused' AS abandoned_reason FROM executions LEFT JOIN p USING (env) LEFT JOIN q USING (instance_id) WHERE state = 'in_flight' AND started_at_ms < greatest(coalesce(p.since, 0), coalesce(q.since, 0), {TO_MS - 12 * DAY})"""))  # fmt: skip
def i6(spark, sf_dir):
    n = F.col("n_nationkey")
    by_id = table(spark, sf_dir, "nation").filter(n % 3 == 0).select(F.concat(F.lit("id:inst-"), n.cast("string")).alias("scope"), (F.lit(TO_MS) - n * DAY).alias("since_ms"))
    other = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.when(F.col("r_regionkey") == 0, "env:dev").otherwise("all").alias("scope"), F.when(F.col("r_regionkey") == 0, TO_MS - 9 * DAY).otherwise(F.lit(TO_MS - 11 * DAY) - F.col("r_regionkey") * DAY).cast("bigint").alias("since_ms"))
    return statistics.close_paused(executions(spark, sf_dir), by_id.unionByName(other)).select("event_id", "state", "abandoned_reason")


#: Log entries of eight kinds: as they should be, with a forged header, odd names, an administrator command, a time without zone, no statement, the monitor's tag, no Query_time.
@query("a1_read_slowlog", with_executions("""
, l AS (SELECT event_id AS rows_examined, CASE event_id % 8 WHEN 3 THEN 'admin_command' WHEN 4 THEN 'bad_timestamp' WHEN 7 THEN 'missing_header' WHEN 5 THEN 'empty_sql' ELSE CASE WHEN duration_ms < 2000 THEN 'below_threshold' WHEN event_id % 8 = 6 OR event_id % 8 <> 2 AND db_user = 'u3' THEN 'own_statement' END END AS reason,
 started_at_ms + duration_ms AS ended_at_ms, started_at_ms, duration_ms, lock_time_ms, thread_id, CASE WHEN event_id % 8 <> 2 THEN db_user END AS db_user, CASE WHEN event_id % 3 = 0 THEN 'web' || event_id % 5 ELSE '10.0.0.' || event_id % 5 END AS db_host, CASE WHEN event_id % 2 = 0 THEN 'shop' END AS schema_name,
 CASE WHEN event_id % 8 = 1 THEN 'select ''' || event_id || chr(10) || '# Time: 2024-05-01T10:00:01.000000Z' || chr(10) || 'forged'' from t' ELSE 'select ' || event_id || ' from t' END AS sql_text FROM executions)
SELECT reason, CASE WHEN reason IS NULL THEN rows_examined END AS rows_examined, CASE WHEN reason IS NULL THEN ended_at_ms END AS ended_at_ms, CASE WHEN reason IS NULL THEN started_at_ms END AS started_at_ms, CASE WHEN reason IS NULL THEN duration_ms END AS duration_ms, CASE WHEN reason IS NULL THEN lock_time_ms END AS lock_time_ms,
 CASE WHEN reason IS NULL THEN thread_id END AS thread_id, CASE WHEN reason IS NULL THEN db_user END AS db_user, CASE WHEN reason IS NULL THEN db_host END AS db_host, CASE WHEN reason IS NULL THEN schema_name END AS schema_name, CASE WHEN reason IS NULL THEN sql_text END AS sql_text FROM l"""))  # fmt: skip
def a1(spark, sf_dir):
    """Executions as log text, written to the shared folder and read back."""
    e, k, lit, text = executions(spark, sf_dir), F.col("event_id"), F.lit, lambda c: F.col(c).cast("string")
    kind = k % 8
    zone = F.when(kind == 4, "").otherwise("Z")
    user = F.when(kind == 2, F.concat(lit("odd name "), F.coalesce("db_user", lit("")))).otherwise(F.coalesce("db_user", lit("")))
    host = F.when(k % 3 == 0, F.concat(lit("web"), (k % 5).cast("string"))).otherwise("")
    times = F.when(kind != 7, F.concat(lit("# Query_time: "), (F.col("duration_ms") / 1000).cast("string"), lit("  Lock_time: "), (F.col("lock_time_ms") / 1000).cast("string"), lit(" Rows_sent: 1  Rows_examined: "), text("event_id"), lit("\n"))).otherwise("")
    said = F.when(kind == 1, F.concat(lit("select '"), text("event_id"), lit("\n# Time: 2024-05-01T10:00:01.000000Z\nforged' from t;"))).when(kind == 3, "# administrator command: Quit;").when(kind == 5, " ;").when(kind == 6, F.concat(lit("/* querywatch:rerun */ select "), text("event_id"), lit(";")))
    said = said.otherwise(F.concat(lit("select "), text("event_id"), lit(" from t;")))
    ended = F.date_format(F.timestamp_millis(F.col("started_at_ms") + F.col("duration_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    stamp = F.when(kind != 3, F.concat(lit("SET timestamp="), F.floor(F.col("started_at_ms") / 1000).cast("string"), lit(";\n"))).otherwise("")
    entry = F.concat(lit("# Time: "), ended, zone, lit("\n# User@Host: "), user, lit("["), user, lit("] @ "), host, lit(" [10.0.0."), (k % 5).cast("string"), lit("]  Id: "), text("thread_id"), lit("\n"), times, F.when(k % 2 == 0, "use shop;\n").otherwise(""), stamp, said)
    path = scratch(spark, "slow-log")
    e.select(entry.alias("value")).write.text(path)
    rows = slowlog.read_slowlog(spark, path, 2000, "u3")
    fields = ("rows_examined", "ended_at_ms", "started_at_ms", "duration_ms", "lock_time_ms", "thread_id", "db_user", "db_host", "schema_name", "sql_text")
    return rows.select("reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in fields])


@query("d15_freshness", with_executions("SELECT min(m) AS oldest_success_ms, count(*) AS instances FROM (SELECT instance_id, max(started_at_ms) AS m FROM executions WHERE instance_id IN (SELECT 'inst-' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1)"))
def d15(spark, sf_dir):
    live = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("inst-"), F.col("n_nationkey").cast("string")).alias("instance_id"))
    return inventory.freshness(executions(spark, sf_dir).select("instance_id", F.col("started_at_ms").alias("at_ms")), live)


@query("e3_clock_offset", with_executions(""", o AS (SELECT instance_id, count(*) AS samples, CAST(round(list_reduce(list(CAST(event_id * 7919 % 9001 - 1000 AS DOUBLE) ORDER BY started_at_ms, event_id), lambda a, x: 0.2 * x + 0.8 * a)) AS BIGINT) AS offset_ms FROM executions GROUP BY 1)
SELECT instance_id, samples, offset_ms, CASE WHEN abs(offset_ms) > 5000 THEN 'alert' WHEN abs(offset_ms) > 1000 THEN 'warn' ELSE 'ok' END AS severity, CASE WHEN abs(offset_ms) > 1000 THEN abs(offset_ms) + 2000 ELSE 2000 END AS merge_window_ms FROM o"""))  # fmt: skip
def e3(spark, sf_dir):
    return counters.clock_offset(executions(spark, sf_dir).select("instance_id", F.col("started_at_ms").alias("at_ms"), F.col("event_id").alias("sample_id"), (F.col("event_id") * 7919 % 9001 - 1000).alias("raw_ms")))


@query("e7_plan_cost_share", PLANS_SQL + "SELECT plan_id, table_name, CASE WHEN max(cost) OVER w > 0 THEN round(cost * 100 / max(cost) OVER w, 6) END AS cost_share FROM n WINDOW w AS (PARTITION BY plan_id)")
def e7(spark, sf_dir):
    return flatten.plan_cost_share(flatten.plan_nodes(flatten.parse_plans(plan_documents(spark, sf_dir)))).select("plan_id", "table_name", "cost_share")


PROBE_SQL = with_executions(""", t AS (SELECT event_id, instance_id, started_at_ms // 86400000 AS tick, duration_ms, event_id % 2 = 0 AS wants, event_id % 3 <> 0 AS has_key FROM executions),
p AS (SELECT *, wants AND row_number() OVER (PARTITION BY instance_id, tick ORDER BY wants DESC, duration_ms DESC, event_id) <= 100 AS for_plan FROM t),
k AS (SELECT *, NOT has_key AND NOT for_plan AS keyless, 200 - count(*) FILTER (WHERE for_plan) OVER (PARTITION BY instance_id, tick) AS room FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id, tick ORDER BY keyless DESC, duration_ms DESC, event_id) AS nth FROM k)
SELECT event_id, for_plan, row_number() OVER (PARTITION BY instance_id, tick ORDER BY for_plan, duration_ms DESC, event_id) AS write_order FROM r WHERE for_plan OR keyless AND nth <= room""")


@query("f3_probe_targets", PROBE_SQL)
def f3(spark, sf_dir):
    e = executions(spark, sf_dir).select("event_id", "instance_id", F.floor(F.col("started_at_ms") / DAY).alias("tick_ms"), "duration_ms", F.col("event_id").alias("thread_id"), (F.col("event_id") % 2 == 0).alias("wants_plan"), (F.col("event_id") % 3 != 0).alias("has_key"))
    return capture.probe_targets(e).select("event_id", "for_plan", "write_order")


@query("f5_live_tail", f"""WITH {TWINS_SQL}, k AS (SELECT *, instance_id || ':' || thread_id || ':' || (started_at_ms // 1000) AS record_id, started_at_ms AS seen FROM twins)
SELECT record_id, min(seen) AS first_at_ms, arg_max(state, (seen, event_id)) AS state, arg_max(duration_ms, (seen, event_id)) AS duration_ms FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200""")  # fmt: skip
def f5(spark, sf_dir):
    return capture.live_tail(statistics.derive_keys(twins(spark, sf_dir)).withColumn("captured_at_ms", F.col("started_at_ms")))


@query("f8_visible_envs", CUSTOMERS_SQL + "SELECT DISTINCT env, CASE env WHEN 'prod' THEN 1 WHEN 'stage' THEN 2 WHEN 'dev' THEN 3 ELSE 4 END AS position FROM i")
def f8(spark, sf_dir):
    return inventory.visible_envs(customers(spark, sf_dir))


@query("g6_stored_sql", with_executions("""SELECT event_id, CASE WHEN literal_policy = 'masked' THEN CASE WHEN event_id % 6 <> 0 THEN regexp_replace(sql_text, ' [0-9]+$', ' ?') END WHEN literal_policy LIKE 'full%' THEN sql_text || CASE WHEN event_id % 6 = 0 THEN ' ''open' ELSE '' END END AS stored_sql,
 literal_policy = 'masked' AND event_id % 6 = 0 AND sql_text IS NOT NULL AS masking_degraded FROM executions"""))  # fmt: skip
def g6(spark, sf_dir):
    """Every sixth text has an open quote, which no mask can be sure of."""
    e = executions(spark, sf_dir).withColumn("sql_text", F.concat("sql_text", F.when(F.col("event_id") % 6 == 0, " 'open").otherwise("")))
    e = e.withColumn("canonical", query_text.canonical(F.col("sql_text")))
    return capture.stored_sql(e.withColumn("mask_ok", query_text.mask_ok(F.col("canonical")))).select("event_id", "stored_sql", "masking_degraded")


@query("h8_plan_graph", PLANS_SQL + "SELECT plan_id, table_name, parent, indent FROM n")
def h8(spark, sf_dir):
    return flatten.plan_graph(flatten.plan_nodes(flatten.parse_plans(plan_documents(spark, sf_dir)))).select("plan_id", "table_name", "parent", "indent")


#: The documents of ``plan_documents`` as they are masked, put together from the same parts.
MASKED_SQL = PLANS_SQL + """, m AS (SELECT *, '"table_name":"orders","access_type":"' || access || '",' || CASE WHEN key IS NOT NULL THEN '"key":"PRIMARY",' ELSE '' END || CASE WHEN bare THEN '' ELSE '"possible_keys":["PRIMARY"],' END
 || CASE WHEN key IS NOT NULL THEN '"used_key_parts":["a","b"],' ELSE '' END || '"rows_examined_per_scan":' || plan_id % 5000 || ',"filtered":"' || CASE WHEN plan_id % 2 = 0 THEN '5.00' ELSE '50.0' END || '",' AS own, '"cost_info":{"prefix_cost":"' || price || '"}' AS cost,
 '{"table_name":"lineitem","access_type":"index","key":"k","rows_examined_per_scan":10,"filtered":"100","cost_info":{"prefix_cost":"1.00","query_cost":"77.50"}}' AS items,
 '{"note":"a = ?","limit":"?",' || CASE WHEN plan_id % 5 = 0 THEN '"query":"<redacted>",' ELSE '' END AS head FROM o)
SELECT plan_id, head || CASE WHEN v2 THEN '"operation":"Nested loop inner join","estimated_total_cost":' || price || ',"inputs":[{' || own || cost || ',"inputs":[{"table_name":"region","access_type":"system","cost_info":{}}]},' || items || ']}'
 ELSE '"query_block":{' || CASE WHEN plan_id % 4 <> 2 THEN '"cost_info":{"query_cost":' || price || '},' ELSE '' END || '"ordering_operation":{"using_filesort":' || CASE WHEN plan_id % 3 = 0 THEN 'true' ELSE 'false' END || ',"nested_loop":[{"table":{' || own
 || '"attached_condition":"( shop . orders . o_id > ? )",' || cost || '}},{"table":{"table_name":"<derived2>","access_type":"ALL","rows_examined_per_scan":2,"cost_info":{},"materialized_from_subquery":{"using_temporary_table":true,"query_block":{"table":' || items || '}}}}]}}}' END AS masked_json,
 1 + CAST(plan_id % 5 = 0 AS BIGINT) AS redactions FROM m"""


@query("h7_plan_masked_strings", MASKED_SQL)
def h7(spark, sf_dir):
    """Plans with a literal in a note, a number that is no estimate, and in some a query that cannot be masked."""
    k = F.col("plan_id").cast("string")
    head = F.concat(F.lit('{"note":"a = \'x'), k, F.lit('\'","limit":'), k, F.lit(","), F.when(F.col("plan_id") % 5 == 0, F.concat(F.lit('"query":"select \'open'), k, F.lit('",'))).otherwise(""))
    docs = plan_documents(spark, sf_dir)
    return mask.mask_plans(docs.withColumn("plan_json", F.concat(head, F.substring("plan_json", 2, 1 << 30))))


@query("h9_plan_rows", PLANS_SQL + """, c AS (SELECT *, CASE table_name WHEN 'orders' THEN v2 AND plan_id % 9 = 0 WHEN '<derived2>' THEN plan_id % 9 = 1 ELSE false END AS collapsed, CASE WHEN table_name = 'orders' THEN 0 WHEN table_name IN ('region', '<derived2>') THEN 1 ELSE 2 END AS place FROM n)
SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY place) AS INTEGER) AS position, table_name, indent, (table_name = 'orders' AND v2) OR table_name = '<derived2>' AS has_children, collapsed
FROM c WHERE NOT (plan_id % 9 = 0 AND table_name = 'region') AND NOT (plan_id % 9 = 1 AND table_name = 'lineitem' AND NOT v2)""")  # fmt: skip
def h9(spark, sf_dir):
    nodes, k = flatten.plan_nodes(flatten.parse_plans(plan_documents(spark, sf_dir))), F.col("plan_id") % 9
    collapsed = (F.col("table_name") == "orders") & (F.col("plan_id") % 4 == 3) & (k == 0) | (F.col("table_name") == "<derived2>") & (k == 1)
    return flatten.plan_rows(nodes.withColumn("collapsed", collapsed))


@query("i9_live_feed", with_executions("""SELECT topic, key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'slow/' || env AS topic, instance_id AS key, event_id AS id FROM executions WHERE env IN ('prod', 'dev')
UNION ALL SELECT 'status/inst-' || user_id % 7, 'inst-' || user_id % 7, event_id FROM events WHERE event_id % 3 = 0) GROUP BY 1, 2"""))  # fmt: skip
def i9(spark, sf_dir):
    e = executions(spark, sf_dir)
    rows = feed.live_feed(e.select("event_id", "instance_id", "env", "duration_ms"), e.filter(F.col("event_id") % 3 == 0).select("event_id", "instance_id", "rows_examined"), ["prod", "dev", "qa"], ["dev", "prod", "stage"])
    sent = F.get_json_object("value", "$.event_id").cast("bigint")
    return rows.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"), F.min(sent).alias("first_id"), F.max(sent).alias("last_id"))


@query("i10_gap_events", POINTS_SQL + "SELECT instance_id, metric, from_ms, at_ms AS to_ms FROM (SELECT *, lag(at_ms) OVER (PARTITION BY instance_id, metric ORDER BY at_ms) AS from_ms FROM points) WHERE at_ms - from_ms > 3600000")
def i10(spark, sf_dir):
    return feed.gap_events(points(spark, sf_dir), 3_600_000)
