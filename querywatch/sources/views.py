"""Operator inputs derived from the given tables, so that their size follows the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from querywatch.operators.counters import SUMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type").isin("view", "click"), "select").when(F.col("event_type") == "purchase", "insert").when(F.col("event_type") == "signup", "ddl").otherwise("other")
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("inst-"), (F.col("user_id") % 7).cast("string")).alias("instance_id"),
        F.col("user_id").cast("bigint").alias("thread_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at_ms"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        kind.alias("statement_type"),
        F.concat("event_type", F.lit("-"), (k % 10).cast("string")).alias("app_digest"),
        F.when(k % 13 != 0, F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))).alias("db_user"),
        F.when(F.col("event_id") % 4 == 0, "processlist").otherwise("slowlog").alias("capture_source"),
        F.when(F.col("event_id") % 11 == 0, "in_flight").otherwise("finalized").alias("state"),
        (F.col("event_id") * 37 % 10007).cast("bigint").alias("rows_examined"),
        (F.col("event_id") * 13 % 500).cast("bigint").alias("lock_time_ms"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("SELECT "), "event_type", F.lit(" "), k.cast("string"))).alias("sql_text"),
        F.element_at(F.array(F.lit("prod"), F.lit("stage"), F.lit("dev")), (F.col("user_id") % 3 + 1).cast("int")).alias("env"),
        F.element_at(F.array(*map(F.lit, ("full", "full_restricted", "masked", "off"))), (F.col("event_id") % 4 + 1).cast("int")).alias("literal_policy"),
    )


EXECUTIONS_SQL = """
x AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
executions AS (SELECT event_id, 'inst-' || (user_id % 7) AS instance_id, CAST(user_id AS BIGINT) AS thread_id, (epoch_us(ts) // 1000) AS started_at_ms,
  CAST(round(value * 1000) AS BIGINT) AS duration_ms,
  CASE WHEN event_type IN ('view', 'click') THEN 'select' WHEN event_type = 'purchase' THEN 'insert' WHEN event_type = 'signup' THEN 'ddl' ELSE 'other' END AS statement_type,
  event_type || '-' || (k % 10) AS app_digest, CASE WHEN k % 13 <> 0 THEN 'u' || (user_id % 20) END AS db_user,
  CASE WHEN event_id % 4 = 0 THEN 'processlist' ELSE 'slowlog' END AS capture_source, CASE WHEN event_id % 11 = 0 THEN 'in_flight' ELSE 'finalized' END AS state,
  CAST(event_id * 37 % 10007 AS BIGINT) AS rows_examined, CAST(event_id * 13 % 500 AS BIGINT) AS lock_time_ms,
  CASE WHEN event_id % 5 <> 0 THEN 'SELECT ' || event_type || ' ' || k END AS sql_text,
  ['prod', 'stage', 'dev'][user_id % 3 + 1] AS env, ['full', 'full_restricted', 'masked', 'off'][event_id % 4 + 1] AS literal_policy FROM x)
"""


def digest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters by instance and digest at each hour that has executions; they restart on day 15. The n-th of SUMS counts ids modulo n + 2."""
    e = executions(spark, sf_dir).withColumn("snapshot_ms", (F.floor(F.col("started_at_ms") / 3600000) + 1) * 3600000)
    hourly = e.groupBy("instance_id", "app_digest", "snapshot_ms").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("t"), F.sum("rows_examined").alias("r"), F.max("duration_ms").alias("m"), F.sum("lock_time_ms").alias("l"), F.min("started_at_ms").alias("f"),
                                                                     *[F.sum(F.col("event_id") % (i + 2)).alias(c) for i, c in enumerate(SUMS)])
    era = (F.col("snapshot_ms") >= 1705276800000).cast("int")
    w = Window.partitionBy("instance_id", "app_digest", "era").orderBy("snapshot_ms")
    run = lambda c: F.sum(c).over(w)
    return hourly.withColumn("era", era).select(
        "instance_id", "app_digest", "snapshot_ms", run("n").alias("count_star"), (run("t") * 1_000_000_000).cast("decimal(20,0)").alias("sum_timer_wait_ps"), run("r").alias("sum_rows_examined"),
        (F.max("m").over(w) * 1_000_000_000).cast("decimal(20,0)").alias("max_timer_wait_ps"), (F.max("m").over(w) * 950_000_000).cast("decimal(20,0)").alias("quantile_95_ps"), *[run(c).alias(f"sum_{c}") for c in SUMS], (run("l") * 1_000_000_000).cast("decimal(20,0)").alias("sum_lock_time_ps"), F.min("f").over(w.partitionBy("instance_id", "app_digest")).alias("first_seen_ms"),
    )


SNAPSHOTS_SQL = EXECUTIONS_SQL + f""",
hourly AS (SELECT instance_id, app_digest, (started_at_ms // 3600000 + 1) * 3600000 AS snapshot_ms, {", ".join(f"CAST(sum(event_id % {i + 2}) AS BIGINT) AS {c}" for i, c in enumerate(SUMS))}, count(*) AS n, sum(duration_ms) AS t, sum(rows_examined) AS r, max(duration_ms) AS m, sum(lock_time_ms) AS l, min(started_at_ms) AS f FROM executions GROUP BY ALL),
snapshots AS (SELECT instance_id, app_digest, snapshot_ms, CAST(sum(n) OVER w AS BIGINT) AS count_star, CAST(sum(t) OVER w AS BIGINT) AS sum_ms, CAST(sum(r) OVER w AS BIGINT) AS sum_rows_examined, max(m) OVER w AS max_ms, max(m) OVER w * 95 // 100 AS p95_ms, {", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in SUMS)},
  CAST(sum(l) OVER w AS BIGINT) AS lock_ms, min(f) OVER (PARTITION BY instance_id, app_digest ORDER BY snapshot_ms) AS first_seen_ms
  FROM hourly WINDOW w AS (PARTITION BY instance_id, app_digest, snapshot_ms >= 1705276800000 ORDER BY snapshot_ms))
"""
