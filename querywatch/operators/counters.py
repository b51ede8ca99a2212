"""Counters: deltas, rates, hourly rollups and metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Stored digests an hour, least total time, and their bounds; gap between live samples.
TOP_N, THRESHOLD_MS = 200, 100
TOP_N_BOUNDS, THRESHOLD_BOUNDS = (10, 2000), (0, 60000)
GAP_MS, KEPT_POINTS = 15_000, 60
OTHER = "_other"


#: Cumulative counters besides executions, time and rows read, and the names of their deltas.
TIMES = {"sum_lock_time_ps": "lock_time"}
SNAPSHOTS = {"max_timer_wait_ps": "max_ms", "quantile_95_ps": "p95_ms"}  # no deltas: the value at the snapshot
SUMS = ("errors", "warnings", "rows_affected", "rows_sent", "created_tmp_tables", "created_tmp_disk_tables", "select_full_join", "select_scan", "sort_merge_passes", "no_index_used", "no_good_index_used")


def digest_delta(df: DataFrame) -> DataFrame:
    """Delta against the previous snapshot of the digest (and schema_name, where there is one).

    A count that fell is a restart, and a digest first seen after the instance's previous snapshot (column first_seen_ms) is
    new in this window: there the value itself counts. Any other first sight is a baseline without deltas. Picoseconds
    become milliseconds after the subtraction, every counter saturates at zero, max_ms is a snapshot.
    """
    key = ["instance_id", *(c for c in ("schema_name",) if c in df.columns), "app_digest"]
    counters = ["count_star", "sum_timer_wait_ps", "sum_rows_examined", *(c for c in (*TIMES, *(f"sum_{c}" for c in SUMS)) if c in df.columns)]
    df = df.withColumn("p", F.lag(F.struct(*counters)).over(Window.partitionBy(*key).orderBy("snapshot_ms")))
    first = F.lit("baseline")
    if "first_seen_ms" in df.columns:
        ticks = df.select("instance_id", "snapshot_ms").distinct()
        ticks = ticks.withColumn("last_ms", F.lag("snapshot_ms").over(Window.partitionBy("instance_id").orderBy("snapshot_ms")))
        df = df.join(ticks, ["instance_id", "snapshot_ms"])
        first = F.when(F.col("first_seen_ms") > F.col("last_ms"), "new_in_window").otherwise(first)
    df = df.withColumn("kind", F.when(F.col("p").isNull(), first).when(F.col("count_star") < F.col("p.count_star"), "reset").otherwise("incremental"))
    kinds = dict(df.dtypes)

    def delta(c: str) -> Column:
        cur = F.col(c)
        out = F.when(F.col("kind") == "incremental", F.greatest(cur - F.col(f"p.{c}"), F.lit(0).cast(kinds[c]))).when(F.col("kind") != "baseline", cur)
        return F.floor(out / F.lit(1_000_000_000)).cast("bigint") if c.endswith("_ps") else out

    names = {"count_star": "count_delta", "sum_timer_wait_ps": "time_ms", "sum_rows_examined": "rows_delta"} | TIMES | {f"sum_{c}": c for c in SUMS}
    in_ms = lambda c: F.floor(F.col(c) / F.lit(1_000_000_000)).cast("bigint")
    shots = [in_ms(c).alias(n) for c, n in SNAPSHOTS.items() if c in df.columns] + (["max_ms"] if "max_ms" in df.columns else [])
    return df.select(*key, "snapshot_ms", "kind", *[delta(c).alias(names[c]) for c in counters], *shots)


#: Cumulative status counters, the names of their rates, and those of them whose fall tells of a restart.
RATES = {"queries": "qps", "slow_queries": "slow_per_sec", "lock_deadlocks": "deadlocks_per_sec", "lock_timeouts": "lock_timeouts_per_sec"}
RESTART = ("uptime_s", "queries", "slow_queries")
GAUGES = ("threads_running", "threads_connected", "max_connections", "lock_waits")


def status_rates(df: DataFrame) -> DataFrame:
    """Rates a second from cumulative status samples (instance_id, at_ms, and what there is of uptime_s and RATES), with the reason for a gap.

    A rate is null behind a gap, where a sample lacks the counter, and where that counter alone has fallen. GAUGES pass through.
    """
    counters = [c for c in dict.fromkeys([*RESTART, *RATES]) if c in df.columns]
    df = df.withColumn("p", F.lag(F.struct("at_ms", *counters)).over(Window.partitionBy("instance_id").orderBy("at_ms")))
    fell = lambda c: F.coalesce(F.col(c) < F.col(f"p.{c}"), F.lit(False))
    reset = F.lit(False)
    for c in RESTART:
        reset = reset | fell(c) if c in counters else reset
    gap = F.when(F.col("p").isNull(), "first_sample").when(F.col("at_ms") <= F.col("p.at_ms"), "non_monotonic_clock").when(reset, "counters_reset")
    rate = lambda c: F.when(gap.isNull() & ~fell(c), F.round((F.col(c) - F.col(f"p.{c}")) * 1000 / (F.col("at_ms") - F.col("p.at_ms")), 6))
    return df.select("instance_id", "at_ms", gap.alias("gap_reason"), *[rate(c).alias(n) for c, n in RATES.items() if c in counters], *[c for c in GAUGES if c in df.columns])


def hourly_rollup(df: DataFrame, top_n: int = TOP_N, threshold_ms: int = THRESHOLD_MS) -> DataFrame:
    """Deltas by hour: digests of at least ``threshold_ms``, the ``top_n`` by time, all else in one residual row."""
    return top_of_hours(hourly_sums(df), top_n, threshold_ms)


#: What is summed over an hour, under which name, and of what the largest counts.
SUMMED = {"count_delta": "executions", "time_ms": "time_ms", "rows_delta": "rows_examined", "lock_time": "lock_time"} | {c: c for c in SUMS}
LARGEST = ("max_ms", "p95_ms")


def hourly_sums(df: DataFrame) -> DataFrame:
    """Deltas by hour, instance and digest, with the minutes that were seen as bits. Counters that the table does not have are left out."""
    at = F.col("snapshot_ms") - 1
    rows = df.filter("time_ms IS NOT NULL").withColumns({"hour": F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH"), "reset_detected": F.col("kind") == "reset", "minutes": F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.floor(at / 60000) % 60).cast("int"))})
    return merge_sums(rows.select(*[c for c in rows.columns if c not in SUMMED], *[F.col(c).alias(n) for c, n in SUMMED.items() if c in rows.columns]))


def merge_sums(sums: DataFrame) -> DataFrame:
    """Several sums of an hour, instance and digest to one."""
    has = set(sums.columns)
    return sums.groupBy("instance_id", "hour", "app_digest").agg(
        *[F.sum(n).alias(n) for n in SUMMED.values() if n in has], *[F.max(n).alias(n) for n in LARGEST if n in has], F.bool_or("reset_detected").alias("reset_detected"), F.bit_or("minutes").alias("minutes"),
        *[F.min(n).alias(n) for n in ("schema_name",) if n in has])


def top_of_hours(sums: DataFrame, top_n: int = TOP_N, threshold_ms: int = THRESHOLD_MS) -> DataFrame:
    """Sums of whole hours to the rows that are kept and the residual one.

    A reset, the minutes seen and the candidates that were cut are those of the instance's hour; the residual has no largest values
    and no schema. Every row says by what it was chosen.
    """
    if not TOP_N_BOUNDS[0] <= top_n <= TOP_N_BOUNDS[1] or not THRESHOLD_BOUNDS[0] <= threshold_ms <= THRESHOLD_BOUNDS[1]:
        raise ValueError("top_n or threshold_ms is out of bounds")
    has = set(sums.columns)
    w = Window.partitionBy("instance_id", "hour")
    enough = F.col("time_ms") >= threshold_ms
    rank = F.row_number().over(w.orderBy(F.desc(enough.cast("int")), F.desc("time_ms"), "app_digest"))
    marked = sums.withColumns({
        "kept": enough & (rank <= top_n), "total_time_all_ms": F.sum("time_ms").over(w), "candidates": F.count_if(enough).over(w), "reset_detected": F.bool_or("reset_detected").over(w), "minutes": F.bit_or("minutes").over(w)})
    name = F.when(F.col("kept"), F.col("app_digest")).otherwise(OTHER)
    minutes = F.bit_count(F.first("minutes"))
    return marked.groupBy("instance_id", "hour", name.alias("app_digest")).agg(
        *[F.sum(n).alias(n) for n in SUMMED.values() if n in has], *[F.max(F.when(F.col("kept"), F.col(n))).alias(n) for n in LARGEST if n in has], *[F.max(F.when(F.col("kept"), F.col(n))).alias(n) for n in ("schema_name",) if n in has],
        F.first("reset_detected").alias("reset_detected"), minutes.alias("partial_minutes"), (minutes < 60).alias("partial"), F.first("total_time_all_ms").alias("total_time_all_ms"), F.count_if(~F.col("kept")).alias("other_digest_count"),
        F.greatest(F.first("candidates") - top_n, F.lit(0)).cast("bigint").alias("truncated_candidates"), F.lit(top_n).alias("top_n"), F.lit(threshold_ms).alias("threshold_ms"),
    )


def coverage(rollup: DataFrame) -> DataFrame:
    """Stored share of an hour's time; null if there is none."""
    kept = F.coalesce(F.sum(F.when(F.col("app_digest") != OTHER, F.col("time_ms"))), F.lit(0))
    total = F.max("total_time_all_ms")
    return rollup.groupBy("instance_id", "hour").agg(F.when(total > 0, F.round(kept / total, 6)).alias("coverage"))


def partial_minutes(df: DataFrame) -> DataFrame:
    """Distinct minutes seen in each hour; fewer than 60 make it partial."""
    ts = F.timestamp_millis("started_at_ms")
    n = F.count_distinct(F.floor(F.col("started_at_ms") / 60000))
    return df.groupBy("instance_id", F.date_format(ts, "yyyy-MM-dd'T'HH").alias("hour")).agg(n.alias("minutes"), (n < 60).alias("partial"))


def read_metric_series(df: DataFrame) -> DataFrame:
    """Parallel arrays of times and values, one row per point."""
    return df.select("instance_id", "metric", F.explode_outer(F.arrays_zip("timestamps_ms", "values")).alias("p")).select("instance_id", "metric", F.col("p.timestamps_ms").alias("at_ms"), F.col("p.values").alias("value"))


def resample(points: DataFrame, period_ms: int, stats: dict[str, str]) -> DataFrame:
    """Each metric by its own statistic (average, minimum, maximum) in windows of the period."""
    bucket = F.floor(F.col("at_ms") / period_ms) * period_ms
    stat = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in stats.items() for x in kv]), F.col("metric")), F.lit("average"))
    value = F.when(F.col("stat") == "minimum", F.min("value")).when(F.col("stat") == "maximum", F.max("value")).otherwise(F.avg("value"))
    return points.withColumn("stat", stat).groupBy("instance_id", "metric", "stat", bucket.alias("bucket_ms")).agg(F.round(value, 6).alias("value")).drop("stat")


def latest_value(points: DataFrame) -> DataFrame:
    return points.groupBy("instance_id", "metric").agg(F.max("at_ms").alias("at_ms"), F.max_by("value", F.struct("at_ms", "value")).alias("value"))


def mark_series_gaps(points: DataFrame, gap_ms: int = GAP_MS, keep: int = KEPT_POINTS) -> DataFrame:
    """A null point before each sample that comes too late; the newest ``keep`` points of a series."""
    w = Window.partitionBy("instance_id", "metric").orderBy("at_ms")
    gap = F.col("at_ms") - F.lag("at_ms").over(w) > gap_ms
    point = F.struct(F.col("at_ms"), F.lit(1).alias("nth"), F.col("value"))
    void = F.struct(F.col("at_ms"), F.lit(0).alias("nth"), F.lit(None).cast("double").alias("value"))
    rows = points.withColumn("gap", F.coalesce(gap, F.lit(False))).select("instance_id", "metric", F.explode(F.when(F.col("gap"), F.array(void, point)).otherwise(F.array(point))).alias("p"))
    newest = F.row_number().over(Window.partitionBy("instance_id", "metric").orderBy(F.desc("p.at_ms"), F.desc("p.nth")))
    return rows.withColumn("rn", newest).filter(F.col("rn") <= keep).select("instance_id", "metric", "p.at_ms", "p.nth", "p.value")


#: Weight of a new clock sample, severity limits and least merge window in ms, warning and alarm percentages.
ALPHA, OFFSET_WARN_MS, OFFSET_ALERT_MS, MERGE_WINDOW_MS = 0.2, 1000, 5000, 2000
SEVERE = {"cpu": (70, 85), "connections": (70, 85), "storage_left": (20, 10)}


def clock_offset(samples: DataFrame) -> DataFrame:
    """Smoothed clock offset of each instance (raw_ms by at_ms), its severity and the merge window.

    A run of samples maps an offset x to a + b·x, so hours fold on their own and only their (a, b) pairs meet.
    """
    step = lambda acc, x: F.struct((ALPHA * x["raw_ms"] + (1 - ALPHA) * acc["a"]).alias("a"), ((1 - ALPHA) * acc["b"]).alias("b"))
    unit = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    rows = samples.select("instance_id", "at_ms", "sample_id", F.col("raw_ms").cast("double").alias("raw_ms"))
    hours = rows.groupBy("instance_id", F.floor(F.col("at_ms") / 3_600_000).alias("hour")).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("at_ms", "sample_id", "raw_ms"))), unit, step).alias("f"), F.min_by("raw_ms", F.struct("at_ms", "sample_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("hour", "f.a", "f.b")))
    # the first sample counts in full: starting from its value gives just that
    total = hours.groupBy("instance_id").agg(F.min_by("first", "hour").alias("first"), ordered.alias("h"), F.sum("n").alias("samples"))
    offset = F.round(F.aggregate("h", F.col("first"), lambda x, h: h["a"] + h["b"] * x)).cast("bigint")
    out = total.select("instance_id", "samples", offset.alias("offset_ms"))
    away = F.abs("offset_ms")
    return out.withColumns({
        "severity": F.when(away > OFFSET_ALERT_MS, "alert").when(away > OFFSET_WARN_MS, "warn").otherwise("ok"),
        "merge_window_ms": F.when(away > OFFSET_WARN_MS, away + MERGE_WINDOW_MS).otherwise(F.lit(MERGE_WINDOW_MS).cast("bigint")),
    })


def metric_severity(df: DataFrame) -> DataFrame:
    """ok, warn or alarm of cpu (percent), connections (of a maximum) and storage left (of what is allocated); null without a denominator."""

    def grade(share: Column, name: str) -> Column:
        warn, alarm = SEVERE[name]
        worse = (lambda x: share >= x) if warn < alarm else (lambda x: share <= x)
        return F.when(share.isNull(), F.lit(None).cast("string")).when(worse(alarm), "alarm").when(worse(warn), "warn").otherwise("ok").alias(f"{name}_severity")

    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100 / F.col(b))
    return df.select("*", grade(F.col("cpu"), "cpu"), grade(part("connections", "max_connections"), "connections"), grade(part("storage_left", "storage"), "storage_left"))
