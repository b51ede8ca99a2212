"""Registered queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from querywatch.functions import query_text
from querywatch.operators import counters, identity, inventory, locks, statistics, tracking
from querywatch.plans import flatten
from querywatch.sources.views import EXECUTIONS_SQL, SNAPSHOTS_SQL, digest_snapshots, executions, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FROM_MS, TO_MS = 1704412800000, 1705708799999  # 2024-01-05 to 2024-01-19


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def with_executions(sql: str) -> str:
    return f"WITH {EXECUTIONS_SQL} {sql}"


KIND = "CASE WHEN statement_type = 'select' THEN 'read' WHEN statement_type IN ('insert','update','delete','replace') THEN 'write' WHEN statement_type = 'ddl' THEN 'ddl' WHEN starts_with(lower(ltrim(coalesce(sql_text,''))), 'commit') THEN 'commit' ELSE 'other' END"
KINDS = ", ".join(f"count(*) FILTER (WHERE {KIND} = '{k}') AS n_{k}" for k in ("read", "write", "ddl", "commit", "other"))


@query("d1_digest_stats", with_executions("""
SELECT instance_id, app_digest, count(*) AS executions, CAST(sum(duration_ms) AS BIGINT) AS total_ms, round(avg(duration_ms), 6) AS avg_ms, max(duration_ms) AS max_ms,
 round(avg(CASE WHEN capture_source <> 'processlist' THEN rows_examined END), 6) AS avg_rows_examined, min(started_at_ms) AS first_seen_ms, max(started_at_ms) AS last_seen_ms,
 coalesce(array_to_string(list_sort(list_distinct(list(db_user) FILTER (WHERE db_user IS NOT NULL))), ','), '') AS users,
 arg_max(sql_text, (started_at_ms, event_id)) FILTER (WHERE sql_text IS NOT NULL) AS sql_text, arg_max(statement_type, (started_at_ms, event_id)) AS statement_type
FROM executions GROUP BY ALL"""))  # fmt: skip
def d1(spark, sf_dir):
    return statistics.digest_stats(executions(spark, sf_dir))


@query("d2_instance_stats", with_executions(f"""
SELECT instance_id, count(DISTINCT app_digest) AS digests, count(*) AS executions, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms,
 CAST(coalesce(sum(rows_examined) FILTER (WHERE capture_source <> 'processlist'), 0) AS BIGINT) AS rows_examined, {KINDS}, min(started_at_ms) AS first_seen_ms, max(started_at_ms) AS last_seen_ms
FROM executions GROUP BY 1"""))  # fmt: skip
def d2(spark, sf_dir):
    return statistics.instance_stats(executions(spark, sf_dir))


@query("d3_user_stats", with_executions(f"""
SELECT instance_id, db_user, count(*) AS executions, count(DISTINCT app_digest) AS digests, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms, {KINDS}
FROM executions WHERE db_user IS NOT NULL GROUP BY 1, 2"""))  # fmt: skip
def d3(spark, sf_dir):
    return statistics.user_stats(executions(spark, sf_dir))


KEYS_SQL = """SELECT *, instance_id || ':' || thread_id || ':' || (started_at_ms // 1000) AS record_id, strftime(make_timestamp(started_at_ms * 1000), '%Y-%m-%d') AS date_part,
 strftime(make_timestamp(started_at_ms * 1000), '%Y-%m-%dT%H') AS hour_bucket, CASE WHEN duration_ms < 5000 THEN 'b0' WHEN duration_ms < 15000 THEN 'b1' WHEN duration_ms < 60000 THEN 'b2' ELSE 'b3' END AS dur_bucket,
 lpad(CAST(started_at_ms AS VARCHAR), 13, '0') || '#' || thread_id AS order_key FROM executions"""


@query("b12_derive_keys", with_executions(f"SELECT event_id, record_id, date_part, hour_bucket, dur_bucket, order_key FROM ({KEYS_SQL})"))
def b12(spark, sf_dir):
    return statistics.derive_keys(executions(spark, sf_dir)).select("event_id", "record_id", "date_part", "hour_bucket", "dur_bucket", "order_key")


@query("b1_time_range", with_executions(f"SELECT event_id, instance_id, started_at_ms FROM executions WHERE started_at_ms BETWEEN {FROM_MS} AND {TO_MS}"))
def b1(spark, sf_dir):
    return statistics.time_range(statistics.derive_keys(executions(spark, sf_dir)), FROM_MS, TO_MS).select("event_id", "instance_id", "started_at_ms")


@query("b2_month_range", with_executions("SELECT event_id, started_at_ms FROM executions WHERE started_at_ms >= 1704034800000 AND started_at_ms < 1706713200000"))
def b2(spark, sf_dir):
    return statistics.month_range(executions(spark, sf_dir), "2024-01").select("event_id", "started_at_ms")


@query("b3_env_scope", with_executions("SELECT env, count(*) AS n FROM executions WHERE env IN ('prod', 'dev') GROUP BY 1"))
def b3(spark, sf_dir):
    return statistics.env_scope(executions(spark, sf_dir), ["prod", "dev", "qa"], ["dev", "prod", "stage"]).groupBy("env").agg(F.count(F.lit(1)).alias("n"))


@query("b4_instance_match", with_executions("SELECT instance_id, count(*) AS n FROM executions WHERE contains(lower(instance_id), 't-3') GROUP BY 1"))
def b4(spark, sf_dir):
    return statistics.instance_match(executions(spark, sf_dir), " T-3 ").groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))


@query("b5_redact", with_executions("""
SELECT event_id, CASE WHEN literal_policy = 'off' THEN 'policy_off' WHEN literal_policy = 'full_restricted' THEN 'restricted' END AS redaction,
 CASE WHEN literal_policy NOT IN ('off', 'full_restricted') THEN sql_text END AS sql_text FROM executions"""))  # fmt: skip
def b5(spark, sf_dir):
    return statistics.redact(executions(spark, sf_dir), "viewer").select("event_id", "redaction", "sql_text")


@query("b6_preview", with_executions("SELECT instance_id, started_at_ms, duration_ms, statement_type, CASE WHEN literal_policy = 'masked' THEN sql_text END AS sql_text FROM executions"))
def b6(spark, sf_dir):
    return statistics.preview(executions(spark, sf_dir))


@query("b17_lock_victim", with_executions("SELECT event_id, duration_ms > 0 AND lock_time_ms * 2 >= duration_ms AS lock_victim FROM executions"))
def b17(spark, sf_dir):
    return statistics.lock_victim(executions(spark, sf_dir)).select("event_id", "lock_victim")


@query("b18_display_duration", with_executions(f"SELECT event_id, CASE WHEN state = 'in_flight' THEN duration_ms + greatest(0, {TO_MS} - started_at_ms - duration_ms) ELSE duration_ms END AS shown_ms FROM executions"))
def b18(spark, sf_dir):
    return statistics.display_duration(executions(spark, sf_dir), TO_MS).select("event_id", "shown_ms")


@query("f2_page", with_executions(f"""SELECT event_id, order_key, instance_id, true AS has_more, CASE WHEN row_number() OVER (ORDER BY order_key, instance_id DESC) = 1 THEN order_key || '|' || instance_id END AS next_position FROM (
SELECT event_id, order_key, instance_id FROM ({KEYS_SQL}) WHERE order_key < '1705000000000#5' OR (order_key = '1705000000000#5' AND instance_id > 'inst-2') ORDER BY order_key DESC, instance_id LIMIT 50)"""))  # fmt: skip
def f2(spark, sf_dir):
    return statistics.page_after(statistics.derive_keys(executions(spark, sf_dir)).select("event_id", "order_key", "instance_id"), ("1705000000000#5", "inst-2"))


@query("f4_in_flight", with_executions("SELECT event_id, instance_id, thread_id, started_at_ms FROM executions WHERE state = 'in_flight' ORDER BY started_at_ms, instance_id, thread_id LIMIT 200"))
def f4(spark, sf_dir):
    return statistics.in_flight(executions(spark, sf_dir), 200).select("event_id", "instance_id", "thread_id", "started_at_ms")


SHARE_SQL = ", ".join(f"""h{i} AS (SELECT *, n > share AS hungry, 2000 - sum(share) OVER () AS left_over, greatest(count(*) FILTER (WHERE n > share) OVER (), 1) AS wanting FROM s{i}),
s{i + 1} AS (SELECT instance_id, n, CASE WHEN hungry THEN least(n, share + left_over // wanting) ELSE share END AS share FROM h{i})""" for i in (0, 1))  # fmt: skip


@query("e9_fair_share", with_executions(f""", c AS (SELECT instance_id, count(*) AS n FROM executions WHERE instance_id <> 'inst-6' OR event_id % 9 = 0 GROUP BY 1), s0 AS (SELECT instance_id, n, least(n, 2000 // count(*) OVER ()) AS share FROM c), {SHARE_SQL}
SELECT event_id, instance_id, n > share AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY started_at_ms DESC, event_id) AS rn FROM executions WHERE instance_id <> 'inst-6' OR event_id % 9 = 0) JOIN s2 USING (instance_id) WHERE rn <= share"""))  # fmt: skip
def e9(spark, sf_dir):
    """One instance has fewer rows than its share, which the others take."""
    return statistics.fair_share(executions(spark, sf_dir).filter("instance_id <> 'inst-6' OR event_id % 9 = 0"), 2000, [F.desc("started_at_ms"), F.col("event_id")]).select("event_id", "instance_id", "truncated")


@query("i5_orphans", with_executions(f"""SELECT event_id, CASE WHEN gone THEN 'abandoned' ELSE state END AS state, CASE WHEN gone THEN 'owner_lost' END AS abandoned_reason
FROM (SELECT *, state = 'in_flight' AND {TO_MS} - (started_at_ms + duration_ms) > 210000 AS gone FROM executions)"""))  # fmt: skip
def i5(spark, sf_dir):
    return statistics.orphans(executions(spark, sf_dir), TO_MS).select("event_id", "state", "abandoned_reason")


DELTAS_SQL = f"""WITH {SNAPSHOTS_SQL},
ticks AS (SELECT instance_id, snapshot_ms, lag(snapshot_ms) OVER (PARTITION BY instance_id ORDER BY snapshot_ms) AS last_ms FROM (SELECT DISTINCT instance_id, snapshot_ms FROM snapshots)),
lagged AS (SELECT s.*, last_ms, lag(count_star) OVER w AS pc, lag(sum_ms) OVER w AS pt, lag(sum_rows_examined) OVER w AS pr, lag(lock_ms) OVER w AS pl, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in counters.SUMS)} FROM snapshots s JOIN ticks USING (instance_id, snapshot_ms) WINDOW w AS (PARTITION BY instance_id, app_digest ORDER BY snapshot_ms)),
kinds AS (SELECT *, CASE WHEN pc IS NULL THEN CASE WHEN first_seen_ms > last_ms THEN 'new_in_window' ELSE 'baseline' END WHEN count_star < pc THEN 'reset' ELSE 'incremental' END AS kind FROM lagged),
deltas AS (SELECT instance_id, app_digest, snapshot_ms, kind, CASE WHEN kind = 'incremental' THEN greatest(count_star - pc, 0) WHEN kind <> 'baseline' THEN count_star END AS count_delta,
 CASE WHEN kind = 'incremental' THEN greatest(sum_ms - pt, 0) WHEN kind <> 'baseline' THEN sum_ms END AS time_ms, CASE WHEN kind = 'incremental' THEN greatest(sum_rows_examined - pr, 0) WHEN kind <> 'baseline' THEN sum_rows_examined END AS rows_delta, max_ms, p95_ms, {", ".join(f"CASE WHEN kind = 'incremental' THEN greatest({c} - p_{c}, 0) WHEN kind <> 'baseline' THEN {c} END AS {c}" for c in counters.SUMS)},
 CASE WHEN kind = 'incremental' THEN greatest(lock_ms - pl, 0) WHEN kind <> 'baseline' THEN lock_ms END AS lock_time FROM kinds)
"""
OVER_HOUR = ("lock_time", *counters.SUMS)
ROLLUP_SQL = DELTAS_SQL + f""",
sums AS (SELECT instance_id, strftime(make_timestamp((snapshot_ms - 1) * 1000), '%Y-%m-%dT%H') AS hour, app_digest, sum(count_delta) AS executions, sum(time_ms) AS time_ms, sum(rows_delta) AS rows_examined, max(max_ms) AS max_ms, max(p95_ms) AS p95_ms, bool_or(kind = 'reset') AS reset,
 {", ".join(f"sum({c}) AS {c}" for c in OVER_HOUR)} FROM deltas WHERE time_ms IS NOT NULL GROUP BY 1, 2, 3),
ranked AS (SELECT *, time_ms >= 300 AND row_number() OVER (PARTITION BY instance_id, hour ORDER BY time_ms >= 300 DESC, time_ms DESC, app_digest) <= 10 AS kept, sum(time_ms) OVER (PARTITION BY instance_id, hour) AS total,
 bool_or(reset) OVER (PARTITION BY instance_id, hour) AS reset_detected, count(*) FILTER (WHERE time_ms >= 300) OVER (PARTITION BY instance_id, hour) AS candidates FROM sums),
rollup AS (SELECT instance_id, hour, CASE WHEN kept THEN app_digest ELSE '_other' END AS app_digest, CAST(sum(executions) AS BIGINT) AS executions, CAST(sum(time_ms) AS BIGINT) AS time_ms, CAST(sum(rows_examined) AS BIGINT) AS rows_examined,
 {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in OVER_HOUR)}, max(max_ms) FILTER (WHERE kept) AS max_ms, max(p95_ms) FILTER (WHERE kept) AS p95_ms, bool_or(reset_detected) AS reset_detected, 1 AS partial_minutes, true AS partial,
 CAST(max(total) AS BIGINT) AS total_time_all_ms, count(*) FILTER (WHERE NOT kept) AS other_digest_count, greatest(max(candidates) - 10, 0) AS truncated_candidates, 10 AS top_n, 300 AS threshold_ms FROM ranked GROUP BY 1, 2, 3)
"""


@query("e1_digest_delta", DELTAS_SQL + "SELECT * FROM deltas WHERE kind <> 'baseline'")
def e1(spark, sf_dir):
    return counters.digest_delta(digest_snapshots(spark, sf_dir)).filter("kind <> 'baseline'")


@query("d8_hourly_rollup", ROLLUP_SQL + "SELECT * FROM rollup")
def d8(spark, sf_dir):
    return counters.hourly_rollup(counters.digest_delta(digest_snapshots(spark, sf_dir)), 10, 300)


@query("d9_coverage", ROLLUP_SQL + "SELECT instance_id, hour, CASE WHEN max(total_time_all_ms) > 0 THEN round(coalesce(sum(time_ms) FILTER (WHERE app_digest <> '_other'), 0) / max(total_time_all_ms), 6) END AS coverage FROM rollup GROUP BY 1, 2")
def d9(spark, sf_dir):
    return counters.coverage(d8(spark, sf_dir))


@query("d10_partial_minutes", with_executions("SELECT instance_id, strftime(make_timestamp(started_at_ms * 1000), '%Y-%m-%dT%H') AS hour, count(DISTINCT started_at_ms // 60000) AS minutes, count(DISTINCT started_at_ms // 60000) < 60 AS partial FROM executions GROUP BY 1, 2"))
def d10(spark, sf_dir):
    return counters.partial_minutes(executions(spark, sf_dir))


#: Status counters and gauges of a sample: of the executions at that time the largest of (id * factor) modulo a number, or null for ids that the last one divides.
STATUS = {"uptime_s": (1, 5000, None), "queries": (3, 90000, None), "slow_queries": (1, 20000, None), "lock_deadlocks": (7, 1000, 11), "lock_timeouts": (1, 40000, None), "threads_running": (5, 90, None), "lock_waits": (1, 3, 5)}


def status_samples(spark, sf_dir):
    e, k = executions(spark, sf_dir), F.col("event_id")
    value = lambda factor, most, skip: F.when(k % skip != 0, k * factor % most) if skip else k * factor % most
    return e.groupBy("instance_id", F.col("started_at_ms").alias("at_ms")).agg(*[F.max(value(*how)).alias(c) for c, how in STATUS.items()])


def _rate_sql(counter: str, name: str) -> str:
    return f"CASE WHEN gap_reason IS NULL AND {counter} >= p_{counter} THEN round(({counter} - p_{counter}) * 1000 / (at_ms - pa), 6) END AS {name}"


@query("e2_status_rates", with_executions(f""", s AS (SELECT instance_id, started_at_ms AS at_ms, {", ".join(f"max(CASE WHEN {f'event_id % {skip} <> 0' if skip else 'true'} THEN event_id * {factor} % {most} END) AS {c}" for c, (factor, most, skip) in STATUS.items())} FROM executions GROUP BY 1, 2),
l AS (SELECT *, lag(at_ms) OVER w AS pa, lag(uptime_s) OVER w AS p_uptime_s, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in counters.RATES)} FROM s WINDOW w AS (PARTITION BY instance_id ORDER BY at_ms)),
g AS (SELECT *, CASE WHEN pa IS NULL THEN 'first_sample' WHEN at_ms <= pa THEN 'non_monotonic_clock' WHEN uptime_s < p_uptime_s OR queries < p_queries OR slow_queries < p_slow_queries THEN 'counters_reset' END AS gap_reason FROM l)
SELECT instance_id, at_ms, gap_reason, {", ".join(_rate_sql(c, n) for c, n in counters.RATES.items())}, threads_running, lock_waits FROM g"""))  # fmt: skip
def e2(spark, sf_dir):
    return counters.status_rates(status_samples(spark, sf_dir))


def points(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("inst-"), (F.col("user_id") % 7).cast("string")).alias("instance_id"), F.col("event_type").alias("metric"), (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000) * 60000).alias("at_ms")).agg(F.round(F.max("value"), 2).alias("value"))


POINTS_SQL = "WITH points AS (SELECT 'inst-' || (user_id % 7) AS instance_id, event_type AS metric, (epoch_us(ts) // 1000) // 60000 * 60000 AS at_ms, round(max(value), 2) AS value FROM events GROUP BY 1, 2, 3)"


@query("d13_resample", POINTS_SQL + "SELECT instance_id, metric, at_ms // 3600000 * 3600000 AS bucket_ms, round(CASE metric WHEN 'view' THEN min(value) WHEN 'click' THEN max(value) ELSE avg(value) END, 6) AS value FROM points GROUP BY 1, 2, 3")
def d13(spark, sf_dir):
    return counters.resample(points(spark, sf_dir), 3_600_000, {"view": "minimum", "click": "maximum"})


@query("d14_latest_value", POINTS_SQL + "SELECT instance_id, metric, max(at_ms) AS at_ms, arg_max(value, at_ms) AS value FROM points GROUP BY 1, 2")
def d14(spark, sf_dir):
    return counters.latest_value(points(spark, sf_dir))


@query("e6_series_gaps", POINTS_SQL + """, g AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY instance_id, metric ORDER BY at_ms) > 3600000 AS gap FROM points),
r AS (SELECT instance_id, metric, at_ms, 1 AS nth, value FROM g UNION ALL SELECT instance_id, metric, at_ms, 0, NULL FROM g WHERE gap)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY instance_id, metric ORDER BY at_ms DESC, nth DESC) <= 60""")  # fmt: skip
def e6(spark, sf_dir):
    return counters.mark_series_gaps(points(spark, sf_dir), 3_600_000)


def twins(spark, sf_dir):
    e = executions(spark, sf_dir)
    copy = e.filter(F.col("event_id") % 5 == 0).withColumns({
        "event_id": F.col("event_id") + 1_000_000_000, "started_at_ms": F.col("started_at_ms") + 400, "duration_ms": F.col("duration_ms") + 50, "db_user": F.concat(F.lit("w"), (F.col("event_id") % 9).cast("string")),
        "app_digest": F.concat(F.lit("unknown-"), F.col("thread_id").cast("string")), "state": F.lit("in_flight"), "capture_source": F.lit("processlist")})
    return e.unionByName(copy)


TWINS_SQL = EXECUTIONS_SQL + """, twins AS (SELECT event_id, instance_id, thread_id, started_at_ms, duration_ms, app_digest, state, capture_source, sql_text, db_user, rows_examined, lock_time_ms, literal_policy, statement_type FROM executions UNION ALL
SELECT event_id + 1000000000, instance_id, thread_id, started_at_ms + 400, duration_ms + 50, 'unknown-' || thread_id, 'in_flight', 'processlist', sql_text, 'w' || (event_id % 9), rows_examined, lock_time_ms, literal_policy, statement_type FROM executions WHERE event_id % 5 = 0)"""


@query("c1_match_same_execution", with_executions(""", echo AS (SELECT event_id, instance_id, thread_id, started_at_ms + event_id % 3 * 600 AS started_at_ms, duration_ms, CASE WHEN event_id % 4 = 0 THEN 'unknown-1' WHEN event_id % 5 = 0 THEN 'other' ELSE app_digest END AS app_digest FROM executions),
p AS (SELECT a.event_id, b.event_id AS partner_id, abs(a.started_at_ms - b.started_at_ms) AS apart_ms FROM executions a JOIN echo b ON a.instance_id = b.instance_id AND a.thread_id = b.thread_id AND abs(a.started_at_ms - b.started_at_ms) <= 1000
 AND (a.app_digest = b.app_digest OR starts_with(b.app_digest, 'unknown-')) AND a.started_at_ms < b.started_at_ms + b.duration_ms AND b.started_at_ms < a.started_at_ms + a.duration_ms)
SELECT event_id, arg_min(partner_id, (apart_ms, partner_id)) AS partner_id, min(apart_ms) AS apart_ms FROM p GROUP BY 1"""))  # fmt: skip
def c1(spark, sf_dir):
    e, k = executions(spark, sf_dir), F.col("event_id")
    echo = e.withColumns({"started_at_ms": F.col("started_at_ms") + k % 3 * 600, "app_digest": F.when(k % 4 == 0, "unknown-1").when(k % 5 == 0, "other").otherwise(F.col("app_digest"))})
    return identity.match_same_execution(e, echo)


@query("d5_dedupe_records", f"""WITH {TWINS_SQL}, k AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN rows_examined END AS rows_examined, CASE WHEN event_id % 6 <> 0 THEN lock_time_ms END AS lock_time_ms), instance_id || ':' || thread_id || ':' || (started_at_ms // 1000) AS record_id,
 (CASE state WHEN 'finalized' THEN 2 WHEN 'abandoned' THEN 1 ELSE 0 END, CAST(capture_source IN ('slowlog', 'merged') AS INT), CAST(event_id % 3 = 0 AS INT), duration_ms, -event_id) AS rank FROM twins),
o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rank DESC) = 1 AS best FROM k)
SELECT record_id, max(event_id) FILTER (WHERE best) AS event_id, max(state) FILTER (WHERE best) AS state, max(capture_source) FILTER (WHERE best) AS capture_source, max(duration_ms) FILTER (WHERE best) AS duration_ms, max(app_digest) FILTER (WHERE best) AS app_digest,
 arg_max(sql_text, rank) FILTER (WHERE sql_text IS NOT NULL) AS sql_text, arg_max(db_user, rank) FILTER (WHERE db_user IS NOT NULL) AS db_user,
 coalesce(max(rows_examined) FILTER (WHERE best), arg_max(rows_examined, rank) FILTER (WHERE rows_examined IS NOT NULL AND capture_source <> 'processlist')) AS rows_examined,
 coalesce(max(lock_time_ms) FILTER (WHERE best), arg_max(lock_time_ms, rank) FILTER (WHERE lock_time_ms IS NOT NULL AND capture_source <> 'processlist')) AS lock_time_ms, count(*) - 1 AS collapsed FROM o GROUP BY 1""")  # fmt: skip
def d5(spark, sf_dir):
    k = F.col("event_id")
    rows = twins(spark, sf_dir).withColumns({"has_plan": k % 3 == 0, "rows_examined": F.when(k % 7 != 0, F.col("rows_examined")), "lock_time_ms": F.when(k % 6 != 0, F.col("lock_time_ms"))})
    return identity.dedupe_records(statistics.derive_keys(rows))


@query("d6_collapse_twins")
def d6(spark, sf_dir):
    return identity.collapse_twins(twins(spark, sf_dir))


@query("d7_merge_observations", f"""WITH {TWINS_SQL}, k AS (SELECT *, event_id % 1000000000 AS execution_id, CASE WHEN state = 'finalized' THEN started_at_ms + duration_ms - 20 END AS ended, event_id >= 1000000000 AS late,
 CASE WHEN event_id >= 1000000000 THEN 'masked' ELSE literal_policy END AS policy, CASE WHEN event_id >= 1000000000 THEN sql_text || ' ?' ELSE sql_text END AS body, CASE WHEN event_id >= 1000000000 THEN 'a' ELSE 'b' END || event_id AS record_id FROM twins),
m AS (SELECT execution_id, arg_min(record_id, (started_at_ms, record_id)) AS record_id, count(*) AS observations, min(started_at_ms) AS started_at_ms, max(ended) FILTER (WHERE ended >= started_at_ms) AS valid_end, max(ended) AS any_end, max(duration_ms) AS longest, max(duration_ms) FILTER (WHERE capture_source = 'slowlog') AS exact,
 CASE WHEN bool_or(state = 'finalized') THEN 'finalized' ELSE 'in_flight' END AS state, coalesce(min(app_digest) FILTER (WHERE NOT starts_with(app_digest, 'unknown-')), min(app_digest)) AS app_digest, CASE WHEN count(DISTINCT capture_source) > 1 THEN 'merged' ELSE min(capture_source) END AS capture_source,
 min(db_user) AS db_user, max(rows_examined) AS most, max(policy) FILTER (WHERE NOT late) AS first_policy, max(body) FILTER (WHERE NOT late) AS first_body, max(body) FILTER (WHERE late) AS late_body, coalesce(max(statement_type) FILTER (WHERE statement_type <> 'other'), 'other') AS statement_type FROM k GROUP BY 1)
SELECT execution_id, record_id, observations, started_at_ms, CASE WHEN observations = 1 THEN any_end ELSE valid_end END AS ended_at_ms, CASE WHEN observations = 1 THEN longest ELSE coalesce(exact, valid_end - started_at_ms, longest) END AS duration_ms,
 CASE WHEN exact IS NOT NULL THEN 'slowlog' WHEN observations > 1 AND valid_end IS NOT NULL THEN 'span' ELSE 'polled' END AS duration_source, state, app_digest, capture_source, db_user, first_policy AS literal_policy, most AS rows_examined, statement_type,
 CASE WHEN observations = 1 THEN first_body WHEN first_policy IN ('full', 'full_restricted') THEN late_body WHEN first_policy = 'masked' THEN late_body END AS sql_text FROM m""")  # fmt: skip
def d7(spark, sf_dir):
    late = F.col("event_id") >= 1_000_000_000
    rows = twins(spark, sf_dir).withColumns({
        "execution_id": F.col("event_id") % 1_000_000_000, "ended_at_ms": F.when(F.col("state") == "finalized", F.col("started_at_ms") + F.col("duration_ms") - 20), "literal_policy": F.when(late, "masked").otherwise(F.col("literal_policy")),
        "literal_policy_at_ms": F.col("started_at_ms"), "captured_at_ms": F.col("started_at_ms"), "record_id": F.concat(F.when(late, "a").otherwise("b"), F.col("event_id").cast("string")), "sql_text": F.when(late, F.concat("sql_text", F.lit(" ?"))).otherwise(F.col("sql_text")), "stats": F.struct("rows_examined")})
    return identity.merge_observations(rows).select(
        "execution_id", "record_id", "observations", "started_at_ms", "ended_at_ms", "duration_ms", "duration_source", "state", "app_digest", "capture_source", "db_user", "literal_policy", "stats.rows_examined", "statement_type", "sql_text")


WAITS_SQL = """WITH s AS (SELECT l_suppkey AS thread_id, arg_max(CASE l_returnflag WHEN 'R' THEN 'select 1 from t where a = ' || l_partkey WHEN 'A' THEN 'select ''it' ELSE 'update T set b = 2' END, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag)) AS t FROM lineitem GROUP BY 1),
w AS (SELECT o.o_orderkey AS wait_id, o.o_custkey AS waiting_thread_id, o.o_custkey % 100 + 1 AS blocking_thread_id, w.c_name AS waiting_user, CAST(w.c_nationkey * 10 AS BIGINT) AS waiting_time_s, b.c_name AS blocking_user, CAST(b.c_nationkey * 10 AS BIGINT) AS blocking_time_s,
 b.c_nationkey % 3 = 0 AS idle, s.t AS blocking_statement, u.t AS waiting_statement, CASE WHEN o_orderkey % 4 <> 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN 't' ELSE 'shop.t' END || o_orderkey % 10 END AS locked_table, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderstatus END AS lock_mode
 FROM orders o JOIN customer w ON w.c_custkey = o.o_custkey LEFT JOIN customer b ON b.c_custkey = o.o_custkey % 100 + 1 LEFT JOIN s ON s.thread_id = o.o_custkey % 100 + 1 LEFT JOIN s u ON u.thread_id = o.o_custkey)"""


def waits(spark, sf_dir):
    """Orders as waits of customers for one of the first hundred; line items are their statements, and three of four waits have a lock."""
    k, orders, li = F.col("o_orderkey"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    asked = orders.select(k.alias("wait_id"), F.col("o_custkey").alias("waiting_thread_id"), (F.col("o_custkey") % 100 + 1).alias("blocking_thread_id"), k.cast("string").alias("requesting_lock_id"), F.lit("INNODB").alias("engine"))
    locked = orders.filter(k % 4 != 3).select(
        k.cast("string").alias("engine_lock_id"), F.lit("INNODB").alias("engine"), F.when(k % 5 != 0, "shop").alias("object_schema"), F.concat(F.lit("t"), (k % 10).cast("string")).alias("object_name"), F.lit("PRIMARY").alias("index_name"), F.col("o_orderstatus").alias("lock_mode"))
    threads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread_id"), F.col("c_name").alias("user"), (F.col("c_nationkey") * 10).cast("bigint").alias("time_s"), F.when(F.col("c_nationkey") % 3 == 0, "Sleep").otherwise("Query").alias("command"))
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("select 1 from t where a = "), F.col("l_partkey").cast("string"))).when(F.col("l_returnflag") == "A", "select 'it").otherwise("update T set b = 2")
    said = li.select(F.col("l_suppkey").alias("thread_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag").alias("statement_id"), text.alias("sql_text"))
    return locks.lock_waits(asked, threads, said, locked)


@query("c3_lock_waits", WAITS_SQL + "SELECT wait_id, waiting_thread_id, blocking_thread_id, waiting_user, waiting_time_s, blocking_user, blocking_time_s, blocking_statement, waiting_statement, locked_table, lock_mode FROM w")
def c3(spark, sf_dir):
    return waits(spark, sf_dir).select("wait_id", "waiting_thread_id", "blocking_thread_id", "waiting_user", "waiting_time_s", "blocking_user", "blocking_time_s", "blocking_statement", "waiting_statement", "locked_table", "lock_mode")


MASK_SQL = "CASE WHEN {0} LIKE 'select 1%' THEN 'SELECT ? FROM t WHERE a = ?' WHEN {0} LIKE 'update%' THEN 'UPDATE t SET b = ?' END"


@query("d18_lock_wait_report", WAITS_SQL + f"""SELECT wait_id, locked_table, coalesce(idle, false) AS blocking_idle, {MASK_SQL.format("waiting_statement")} AS waiting_statement, {MASK_SQL.format("blocking_statement")} AS blocking_statement,
 CASE WHEN waiting_statement LIKE '%it' THEN 1 ELSE 0 END + CASE WHEN blocking_statement LIKE '%it' THEN 1 ELSE 0 END AS sql_withheld FROM w""")  # fmt: skip
def d18w(spark, sf_dir):
    return locks.lock_wait_report(waits(spark, sf_dir)).select("wait_id", "locked_table", "blocking_idle", "waiting_statement", "blocking_statement", "sql_withheld")


def metadata_locks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner_thread_id"), F.col("l_returnflag").alias("object_schema"), (F.col("l_partkey") % 400).alias("object_name"),
                                                   F.when((F.col("l_partkey") % 400 < 40) & (F.col("l_linenumber") == 4), "PENDING").otherwise("GRANTED").alias("lock_status"))


MDL_SQL = "WITH m AS (SELECT l_orderkey AS owner_thread_id, l_returnflag AS object_schema, l_partkey % 400 AS object_name, CASE WHEN l_partkey % 400 < 40 AND l_linenumber = 4 THEN 'PENDING' ELSE 'GRANTED' END AS lock_status FROM lineitem), q AS (SELECT * FROM m WHERE (object_schema, object_name) IN (SELECT (object_schema, object_name) FROM m WHERE lock_status = 'PENDING'))"


@query("c6_metadata_lock_queue", MDL_SQL + """SELECT q.*, o_custkey AS owner_time_s, o_orderstatus AS owner_command, c_name AS sql_text FROM q JOIN orders ON o_orderkey = owner_thread_id LEFT JOIN customer ON c_custkey = o_custkey""")
def c6(spark, sf_dir):
    """Orders as threads, the names of their customers as statements."""
    orders = table(spark, sf_dir, "orders")
    threads = orders.select(F.col("o_orderkey").alias("thread_id"), F.col("o_custkey").alias("time_s"), F.col("o_orderstatus").alias("command"))
    said = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("thread_id"), F.lit(1).alias("statement_id"), F.col("c_name").alias("sql_text"))
    held = metadata_locks(spark, sf_dir).withColumn("object_type", F.lit("TABLE"))
    other = held.limit(1).withColumns({"object_type": F.lit("GLOBAL"), "lock_status": F.lit("PENDING")})
    return locks.metadata_lock_queue(held.unionByName(other), threads, said).drop("object_type")


@query("d18_lock_report", MDL_SQL + "SELECT object_schema, object_name, count(*) FILTER (WHERE lock_status = 'PENDING') AS pending, count(*) FILTER (WHERE lock_status = 'GRANTED') AS granted FROM q GROUP BY 1, 2")
def d18(spark, sf_dir):
    return locks.lock_report(locks.metadata_lock_queue(metadata_locks(spark, sf_dir)))


C8_SQL = """SELECT c_custkey AS id, c_name AS name, action, CAST(CASE WHEN found THEN 0 WHEN action IN ('missing', 'deleted') AND NOT soon THEN m + 1 ELSE m END AS INT) AS missing_count FROM (
SELECT *, CASE WHEN found AND NOT known THEN 'insert' WHEN found THEN 'update' WHEN c_custkey % 17 = 0 THEN 'none' WHEN c_acctbal < -500 THEN CASE WHEN c_custkey % 19 = 0 THEN 'none' ELSE 'excluded' END
 WHEN 's' || (c_nationkey % 5) NOT IN (SELECT 's' || r_regionkey FROM region WHERE r_name <> 'EUROPE') THEN 'out_of_scope' WHEN m + CAST(NOT soon AS INT) >= 2 THEN 'deleted' ELSE 'missing' END AS action
FROM (SELECT *, c_mktsegment <> 'MACHINERY' AS known, c_acctbal > 0 AS found, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey % 2 ELSE 0 END AS m, 10000 - c_custkey % 7 * 1000 < 5000 AS soon FROM customer) WHERE known OR found)"""


@query("c8_reconcile", C8_SQL)
def c8(spark, sf_dir):
    """Customers as instances: what the registry knows and what a round has found differ by segment and balance."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumns({"id": k, "name": F.col("c_name")})
    known = c.filter("c_mktsegment <> 'MACHINERY'").select(
        "id", "name", (k % 2).cast("int").alias("missing_count"), F.concat(F.lit("s"), (F.col("c_nationkey") % 5).cast("string")).alias("scope"), (k % 17 == 0).alias("deleted"),
        F.when(k % 19 == 0, "excluded").otherwise("active").alias("state"), (k % 7 * 1000).alias("last_missing_ms"))
    scopes = table(spark, sf_dir, "region").filter("r_name <> 'EUROPE'").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("scope"))
    return inventory.reconcile(known, c.filter("c_acctbal > 0").select("id", "name"), c.filter("c_acctbal < -500").select("id"), scopes, 10_000, 10_000)


@query("d12_inventory_report", "WITH r AS (" + C8_SQL + ") SELECT action, count(*) AS n, false AS mostly_failing FROM r GROUP BY 1")
def d12(spark, sf_dir):
    return inventory.inventory_report(c8(spark, sf_dir))


@query("f7_set_difference", "SELECT c_custkey AS id, 'start' AS action FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'stop' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def f7(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return inventory.set_difference(c.filter("id % 2 = 0"), c.filter("id % 3 = 0"))


@query("b13_classify_env", "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'prod' WHEN 'MACHINERY' THEN 'stage' ELSE CASE WHEN c_nationkey % 4 = 0 THEN 'dev' ELSE 'unknown' END END AS env FROM customer")
def b13(spark, sf_dir):
    tags = F.create_map(F.lit("Environment"), F.col("c_mktsegment"), F.lit("STAGE"), (F.col("c_nationkey") % 4).cast("string"))
    return inventory.classify_env(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tags.alias("tags")), ["environment", "stage"], {"building": "prod", "Machinery": "stage", "0": "dev"}).select("id", "env")


#: Statements of several kinds (a key stands for each {}): their canonical text, type and tables, whether the mask holds and whether the text is cut.
STATEMENTS = [
    ("select /* run */ * from orders o where o_orderkey in ({}, 7) and `o_status` <> 'F'", "SELECT * FROM orders o WHERE o_orderkey IN ( ... ) AND o_status != ?", "select", "orders", True, False),
    ("SELECT a.x, b.y FROM shop.a a, b AS c WHERE a.id=b.id -- {}", "SELECT a . x , b . y FROM shop . a a , b AS c WHERE a . id = b . id", "select", "b,shop.a", True, False),
    ("with c as (select id from s where id = {}) update t force index (i) set v = {} where d > now() - interval 1 sql_tsi_day", "WITH c AS ( SELECT id FROM s WHERE id = ? ) UPDATE t FORCE INDEX ( i ) SET v = ? WHERE d > now ( ) - INTERVAL ? day", "update", "s,t", True, False),
    ("insert into t values ({},'x'),(2,'y''z'); ", "INSERT INTO t VALUES ( ... )", "insert", "", True, False),
    ("(select distinctrow cast(a as int), current_date from t1 x join (select * from t2 where c regexp '{}') y on x.i = y.i, t3 for update)", "( SELECT DISTINCT cast ( a AS INTEGER ) , curdate FROM t1 x JOIN ( SELECT * FROM t2 WHERE c RLIKE ? ) y ON x . i = y . i , t3 FOR UPDATE )", "select", "t1", True, False),
    ("delete from `Archive`.`Log` where at < '{}' limit 5;", "DELETE FROM archive . log WHERE at < ? LIMIT ?", "delete", "archive.log", True, False),
    ("with x as (select ((((((((((f({})+a)))))))))) delete from u where i in (select j from ((((((((v)))))))) w, z)", "WITH x AS ( SELECT ( ( ( ( ( ( ( ( ( ( f ( ... ) + a ) ) ) ) ) ) ) ) ) ) DELETE FROM u WHERE i IN ( SELECT j FROM ( ( ( ( ( ( ( ( v ) ) ) ) ) ) ) ) w , z )", "other", "u,z", True, False),
    ("((with x as (select ((((((((1)))))))) from q) replace into r select * from x where d > interval '{}' day_hour))", "( ( WITH x AS ( SELECT ( ( ( ( ( ( ( ( ... ) ) ) ) ) ) ) ) FROM q ) REPLACE INTO r SELECT * FROM x WHERE d > INTERVAL ? DAY_HOUR ) )", "replace", "q,x", True, False),
    ("select a from t where b = {} and c = 'it", "SELECT a FROM t WHERE b = ? AND c = ' it", "select", "t", False, False),
    ("alter table t add key (a), add c varchar({}) default ", "ALTER TABLE t ADD KEY ( a ) , ADD c VARCHAR ( ... ) DEFAULT", "ddl", "", True, False),
    ("select a.b, {} from t group by a.b having max(c) >", "SELECT a . b , ? FROM t GROUP BY a . b HAVING max ( c ) >", "select", "t", True, True),
]
CANONICAL_SQL = " UNION ALL ".join(f"SELECT {i} AS kind, $${c}$$ AS canonical, '{t}' AS statement_type, '{names}' AS tables, {ok} AS mask_ok, {cut} AS truncated" for i, (_, c, t, names, ok, cut) in enumerate(STATEMENTS))


@query("g1_digest_query_log", f"""WITH s AS ({CANONICAL_SQL}) SELECT substr(sha256(canonical), 1, 32) AS app_digest, canonical, statement_type, mask_ok, tables, count(*) AS executions, truncated
FROM orders JOIN s ON o_orderkey % {len(STATEMENTS)} = kind GROUP BY ALL""")  # fmt: skip
def g1(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    forms = F.array(*[F.lit(form.replace("{}", "%1$s")) for form, *_ in STATEMENTS])
    text = F.replace(F.get(forms, (F.col("o_orderkey") % len(STATEMENTS)).cast("int")), F.lit("%1$s"), F.col("o_orderkey").cast("string"))
    return query_text.digest_query_log(o.select(text.alias("sql_text")))


def plan_documents(spark, sf_dir):
    """A plan for each order: three of four nested (a sort over a join with a materialised sub-query), the others in the second format."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").repartition("o_orderkey").withColumn("plan_id", F.col("o_orderkey"))  # over all cores, however few pieces the file has
    k, lit, price = F.col("plan_id"), F.lit, F.round(F.col("o_totalprice"), 2)
    never = lambda c: F.when(lit(False), c)  # noqa: E731  absent here, but of that type

    def node(name, access, key, keys, parts, rows, filtered, cost, total, condition, **below):
        fields = {"table_name": lit(name), "access_type": access, "key": key, "possible_keys": keys, "used_key_parts": parts, "rows_examined_per_scan": rows, "filtered": filtered, "attached_condition": condition}
        fields["cost_info"] = F.struct(cost.cast("string").alias("prefix_cost"), total.cast("string").alias("query_cost"))
        return F.struct(*[v.cast("array<string>" if n.endswith(("keys", "parts")) else "bigint" if n.startswith("rows") else "string").alias(n) if n != "cost_info" else v.alias(n) for n, v in fields.items()], *[v.alias(n) for n, v in below.items()])

    no = lit(None)
    of_orders = (F.when(k % 3 == 0, "ALL").otherwise("ref"), F.when(k % 3 != 0, "PRIMARY"), F.when((k % 3 != 0) | (k % 2 == 0), F.array(lit("PRIMARY"))), F.when(k % 3 != 0, F.array(lit("a"), lit("b"))),
                 k % 5000, F.when(k % 2 == 0, "5.00").otherwise("50.0"), price, no)
    of_items = (lit("index"), lit("k"), no, no, lit(10), lit(100), lit("1.00"), lit("77.50"), no)
    part = F.struct(lit(True).alias("using_temporary_table"), F.struct(node("lineitem", *of_items).alias("table")).alias("query_block"))
    derived = node("<derived2>", lit("ALL"), no, no, no, lit(2), no, no, no, no, materialized_from_subquery=part)
    orders = node("orders", *of_orders, lit("(`shop`.`orders`.`o_id` > 5)"), materialized_from_subquery=never(part))
    sort = F.struct((k % 3 == 0).alias("using_filesort"), F.array(F.struct(orders.alias("table")), F.struct(derived.alias("table"))).alias("nested_loop"))
    first = F.struct(F.struct(F.when(k % 4 != 2, F.struct(price.alias("query_cost"))).alias("cost_info"), sort.alias("ordering_operation")).alias("query_block"))
    region = F.array(node("region", lit("system"), *[no] * 8))
    second = F.struct(lit("Nested loop inner join").alias("operation"), price.alias("estimated_total_cost"), F.array(node("orders", *of_orders, no, inputs=region), node("lineitem", *of_items, inputs=never(region))).alias("inputs"))
    doc = F.when(k % 4 == 3, F.to_json(second)).otherwise(F.to_json(first))
    return o.select("plan_id", F.concat(lit("d"), (k % 50).cast("string")).alias("app_digest"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("seen_ms"), doc.alias("plan_json"))


PLANS_SQL = """WITH o AS (SELECT o_orderkey AS plan_id, o_orderkey % 4 = 3 AS v2, CASE WHEN o_orderkey % 3 = 0 THEN 'ALL' ELSE 'ref' END AS access, CASE WHEN o_orderkey % 3 <> 0 THEN 'PRIMARY' END AS key, o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AS bare,
 CASE WHEN o_orderkey % 2 = 0 THEN 5.0 ELSE 50.0 END AS filtered, round(o_totalprice, 2) AS price, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS seen_ms FROM orders),
n AS (SELECT plan_id, v2, 'orders' AS table_name, access AS access_type, key, bare, plan_id % 5000 AS rows_examined, filtered, price AS cost, NULL AS parent, 0 AS indent FROM o
UNION ALL SELECT plan_id, v2, 'lineitem', 'index', 'k', true, 10, 100.0, 1.0, CASE WHEN NOT v2 THEN '<derived2>' END, CAST(NOT v2 AS INT) FROM o
UNION ALL SELECT plan_id, v2, '<derived2>', 'ALL', NULL, true, 2, NULL, NULL, NULL, 0 FROM o WHERE NOT v2
UNION ALL SELECT plan_id, v2, 'region', 'system', NULL, true, NULL, NULL, NULL, 'orders', 1 FROM o WHERE v2),
shape AS (SELECT *, CASE WHEN v2 THEN '1|inputs|orders|' || access || '|' || coalesce(key || '|a,b', '-|') || chr(10) || '2|inputs|region|system|-|' || chr(10) || '1|inputs|lineitem|index|k|' || chr(10)
 ELSE '4|table|orders|' || access || '|' || coalesce(key || '|a,b', '-|') || chr(10) || '4|table|<derived2>|ALL|-|' || chr(10) || '7|table|lineitem|index|k|' || chr(10) END AS text FROM o)
"""


@query("h3_plan_warnings", PLANS_SQL + """SELECT plan_id, table_name, unnest([x FOR x IN [CASE WHEN access_type = 'ALL' THEN 'full_scan' END, CASE WHEN access_type = 'index' THEN 'full_index_scan' END, CASE WHEN key IS NULL AND access_type <> 'system' THEN 'no_index' END,
 CASE WHEN bare AND access_type = 'ALL' THEN 'no_possible_keys' END, CASE WHEN filtered < 10 AND rows_examined >= 1000 THEN 'low_filtered' END] IF x IS NOT NULL]) AS warning FROM n WHERE table_name <> '<derived2>'
UNION ALL SELECT plan_id, NULL, 'filesort' FROM o WHERE NOT v2 AND plan_id % 3 = 0 UNION ALL SELECT plan_id, NULL, 'temporary_table' FROM o WHERE NOT v2""")  # fmt: skip
def h3(spark, sf_dir):
    return flatten.plan_warnings(flatten.parse_plans(plan_documents(spark, sf_dir)))


@query("h1_plan_nodes", PLANS_SQL + """SELECT plan_id, CASE WHEN table_name = 'lineitem' THEN CASE WHEN v2 THEN 1 ELSE 7 END WHEN table_name = 'region' THEN 2 WHEN v2 THEN 1 ELSE 4 END AS depth, CASE WHEN v2 THEN 'inputs' ELSE 'table' END AS role, table_name, access_type, key,
 CASE WHEN bare THEN 0 ELSE 1 END AS possible_keys, CAST(rows_examined AS BIGINT) AS rows_examined, CAST(filtered AS DOUBLE) AS filtered, CAST(cost AS DOUBLE) AS cost FROM n""")  # fmt: skip
def h1(spark, sf_dir):
    nodes = flatten.plan_nodes(flatten.parse_plans(plan_documents(spark, sf_dir)))
    return nodes.select("plan_id", "depth", "role", "table_name", "access_type", "key", F.size("possible_keys").alias("possible_keys"), "rows_examined", "filtered", "cost")


@query("h2_plan_format", PLANS_SQL + "SELECT CASE WHEN v2 THEN 'v2' ELSE 'v1' END AS format, count(*) AS plans FROM o GROUP BY 1")
def h2(spark, sf_dir):
    return flatten.parse_plans(plan_documents(spark, sf_dir)).groupBy("format").agg(F.count(F.lit(1)).alias("plans"))


@query("d16_plan_summary", PLANS_SQL + """SELECT plan_id, CASE WHEN v2 THEN 'v2' ELSE 'v1' END AS format, CAST(3 AS BIGINT) AS nodes, CAST(greatest(plan_id % 5000, 10) AS BIGINT) AS max_rows_examined, CAST(CASE WHEN plan_id % 4 = 2 THEN 77.5 ELSE price END AS DOUBLE) AS cost,
 substr(sha256(text), 1, 16) AS fingerprint, CASE WHEN v2 THEN 'main.lineitem,main.orders,main.region' ELSE 'main.lineitem,shop.orders' END AS tables FROM shape""")  # fmt: skip
def d16(spark, sf_dir):
    return flatten.plan_summary(flatten.parse_plans(plan_documents(spark, sf_dir)), "main")


@query("h10_plan_change", PLANS_SQL + "SELECT 'd' || (plan_id % 50) AS app_digest, count(DISTINCT text) AS shapes, count(*) AS plans, min(seen_ms) AS first_seen_ms, max(seen_ms) AS last_seen_ms FROM shape GROUP BY 1")
def h10(spark, sf_dir):
    parsed = flatten.parse_plans(plan_documents(spark, sf_dir), ("plan_id", "app_digest", "seen_ms"))
    return flatten.plan_change(parsed.select("app_digest", "seen_ms", flatten.fingerprint(F.col("nodes")).alias("fingerprint")))


@query("e4_track_executions", """WITH runs AS (SELECT 'inst-' || (l_suppkey % 7) AS instance_id, l_orderkey AS thread_id, 'd' || l_linenumber AS digest, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) AS start, CAST(l_quantity AS BIGINT) AS seconds, 5 AS step FROM lineitem
 UNION ALL SELECT 'slow-' || l_orderkey || '-' || epoch_ms(CAST(l_shipdate AS TIMESTAMP)), l_orderkey, 'd' || l_linenumber, epoch_ms(CAST(l_shipdate AS TIMESTAMP)), CAST(l_quantity AS BIGINT) * 300, 600 FROM lineitem WHERE l_orderkey % 50 = 0),
seen AS (SELECT *, unnest(range(0, seconds + 1, step)) AS time_secs FROM runs),
obs AS (SELECT instance_id, start + time_secs * 1000 AS tick_ms, thread_id, time_secs, CASE WHEN (time_secs + thread_id) % 4 <> 0 THEN digest END AS digest FROM seen),
ticks AS (SELECT instance_id, tick_ms, tick_ms % 10000 <> 5000 AS whole FROM obs GROUP BY ALL),
marked AS (SELECT *, sum(CAST(whole AS INT)) OVER (PARTITION BY instance_id ORDER BY tick_ms) AS complete, sum(CAST(whole AS INT)) OVER (PARTITION BY instance_id ORDER BY tick_ms) - CAST(whole AS INT) AS complete_before FROM ticks),
one AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY instance_id, tick_ms, thread_id ORDER BY time_secs DESC, digest DESC NULLS LAST) = 1),
f AS (SELECT one.*, complete, complete_before, coalesce(time_secs < lag(time_secs) OVER w OR complete_before > lag(complete) OVER w, true) AS fresh FROM one JOIN marked USING (instance_id, tick_ms) WINDOW w AS (PARTITION BY instance_id, thread_id ORDER BY tick_ms)),
i AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY instance_id, thread_id ORDER BY tick_ms) AS island FROM f),
k AS (SELECT *, fresh OR coalesce(digest <> last_value(digest IGNORE NULLS) OVER (PARTITION BY instance_id, thread_id, island ORDER BY tick_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new FROM i),
u AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY instance_id, thread_id ORDER BY tick_ms) AS whole_run FROM k),
r AS (SELECT *, whole_run * 1000 + (row_number() OVER (PARTITION BY instance_id, thread_id, whole_run ORDER BY tick_ms) - 1) // CASE WHEN starts_with(instance_id, 'slow-') THEN 8 ELSE 1000 END AS run FROM u),
g AS (SELECT instance_id, thread_id, run, min(tick_ms) - arg_min(time_secs, tick_ms) * 1000 AS started_at_ms, max(time_secs) * 1000 AS duration_ms, arg_min(digest, tick_ms) FILTER (WHERE digest IS NOT NULL) AS app_digest, count(*) AS sightings,
 max(tick_ms) AS last_seen_ms, max(complete) AS complete, min(complete_before) AS complete_before FROM r GROUP BY ALL),
e AS (SELECT g.*, lead(complete_before) OVER (PARTITION BY instance_id, thread_id ORDER BY run) AS after, m.complete AS all_complete FROM g JOIN (SELECT instance_id, max(complete) AS complete FROM marked GROUP BY 1) m USING (instance_id)),
n AS (SELECT *, CASE WHEN starts_with(instance_id, 'slow-') AND sightings = 8 THEN 'too_long' WHEN coalesce(after, all_complete) > complete THEN 'disappeared' WHEN after IS NOT NULL THEN 'thread_reused' END AS end_reason FROM e)
SELECT instance_id, thread_id, started_at_ms, duration_ms, app_digest, sightings, last_seen_ms, end_reason, CASE WHEN end_reason IS NOT NULL THEN 'finalized' ELSE 'in_flight' END AS state FROM n""")  # fmt: skip
def e4(spark, sf_dir):
    """Lines as runs of up to 50 s, seen every 5 s; of every fiftieth order also as runs of up to four hours, on an instance for each day, seen every 10 min."""
    k = F.col("l_orderkey")
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), k.alias("thread_id"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("digest"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("start"), F.col("l_quantity").cast("bigint").alias("seconds"))
    kind = lambda name, factor, step: F.struct(F.concat(*name).alias("instance_id"), (F.col("seconds") * factor).alias("seconds"), F.lit(step).cast("bigint").alias("step"))
    fast = kind((F.lit("inst-"), (F.col("supplier") % 7).cast("string")), 1, 5)
    slow = F.when(F.col("thread_id") % 50 == 0, kind((F.lit("slow-"), F.col("thread_id").cast("string"), F.lit("-"), F.col("start").cast("string")), 300, 600))
    runs = runs.select("thread_id", "digest", "start", F.explode(F.array_compact(F.array(fast, slow))).alias("r")).select("thread_id", "digest", "start", "r.*")
    # the sightings of a run are one row, so that they are dealt as one; of runs with one begin and step the longest has the ticks of all
    ticks_of = F.sequence(F.col("start"), F.col("start") + F.col("seconds") * 1000, F.col("step") * 1000)
    digest = F.transform("time_secs", lambda s: F.when((s + F.col("thread_id")) % 4 != 0, F.col("digest")))
    obs = runs.withColumn("time_secs", F.sequence(F.lit(0).cast("bigint"), F.col("seconds"), F.col("step")))
    obs = obs.select("instance_id", ticks_of.alias("tick_ms"), "thread_id", "time_secs", digest.alias("digest"), F.lit("app").alias("db_user"))
    ticks = runs.groupBy("instance_id", "start", "step").agg(F.max("seconds").alias("seconds")).select("instance_id", F.explode(ticks_of).alias("tick_ms"))
    ticks = ticks.withColumn("truncated", F.col("tick_ms") % 10000 == 5000)
    return tracking.track_executions(obs, ticks)
