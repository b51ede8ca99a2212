"""From process-list ticks and history to execution records: what to keep, probe, attach and show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

#: Commands that run nothing, bytes at which a process-list text may be cut, probes and plans a tick, list sizes.
IDLE_COMMANDS = ("Sleep", "Daemon", "Binlog Dump", "Binlog Dump GTID", "Connect")
INFO_BYTES, PROBES, PLANS, PLAN_LIST, TAIL = 65_535, 200, 100, 500, 200
UNKNOWN = "unknown-"


def read_processlist(snapshots: DataFrame, min_secs: int, exclude_schemas: list[str], exclude_users: list[str], limit: int) -> DataFrame:
    """Running statements of each tick, longest first up to ``limit``; truncated tells that more were there."""
    schema_ok = F.col("schema_name").isNull() | ~F.col("schema_name").isin(exclude_schemas)
    user_ok = F.col("db_user").isNull() | ~F.col("db_user").isin(exclude_users)
    rows = snapshots.filter(~F.col("command").isin(*IDLE_COMMANDS) & (F.col("time_secs") >= min_secs) & schema_ok & user_ok)
    tick = Window.partitionBy("instance_id", "tick_ms")
    rows = rows.withColumns({"rn": F.row_number().over(tick.orderBy(F.desc("time_secs"), "thread_id")), "truncated": F.count(F.lit(1)).over(tick) > limit})
    return rows.filter(F.col("rn") <= limit).drop("rn")


def final_counters_only(df: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of statements that have not ended are not final: null."""
    return df.withColumns({c: F.when(F.col("end_event_id").isNotNull(), F.col(c)) for c in counters})


def pick_sql_text(df: DataFrame) -> DataFrame:
    """The longer of list_text and history_text (the latter on a tie), whether it may be cut, and whether bytes may be lost."""
    listed, kept = F.col("list_text"), F.col("history_text")
    from_history = kept.isNotNull() & (listed.isNull() | (F.char_length(kept) >= F.char_length(listed)))
    text = F.when(from_history, kept).otherwise(listed)
    cut = F.when(text.isNull(), F.lit(None).cast("boolean")).when(listed.isNull(), True).otherwise(F.octet_length(listed) >= INFO_BYTES)
    return df.withColumns({"sql_text": text, "sql_text_truncated": cut, "sql_text_lossy": F.when(text.isNotNull(), ~from_history)})


def drop_own(df: DataFrame, monitor_user: str, tag: str) -> DataFrame:
    """Without the monitor's own statements, by user or by the tag that leads their text."""
    own = (F.col("db_user") == monitor_user) | F.ltrim("sql_text").startswith(tag)
    return df.filter(~F.coalesce(own, F.lit(False)))


def quality_gate(df: DataFrame, threshold_ms: int) -> DataFrame:
    """skip_reason of log entries: the first rule that fails, null for those to keep."""
    return df.withColumn(
        "skip_reason",
        F.when(F.col("started_at_ms").isNull(), "bad_timestamp").when(F.trim(F.coalesce(F.col("sql_text"), F.lit(""))) == "", "empty_sql")
        .when(F.col("sql_text").startswith("administrator command"), "admin_command").when(F.col("duration_ms") < threshold_ms, "below_threshold")
        .when(~F.col("duration_ms").between(0, 86_400_000), "implausible_duration"),
    )


def skip_report(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("skip_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: What a tick is judged by: the sum of each over its candidates.
TICK = {
    "candidates": "true", "probed": "probed", "probes_skipped": "NOT probed", "finalized": "state = 'finalized'", "with_history": "state = 'finalized' AND has_history", "plans_for_connection": "plan_source = 'for_connection'",
    "plans_rerun": "plan_source = 'rerun'", "plans_rerun_as_select": "plan_source = 'rerun_as_select'", "plans_failed": "probed AND wants_plan AND plan_source = 'none'", "masking_degraded": "masking_degraded", "evicted": "end_reason = 'evicted'",
}


def tick_counts() -> list[Column]:
    return [F.count_if(F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in TICK.items()]


def tick_report(df: DataFrame) -> DataFrame:
    """The counts of TICK for each instance and tick (columns probed, wants_plan, state, has_history, plan_source, masking_degraded, end_reason)."""
    return df.groupBy("instance_id", "tick_ms").agg(*tick_counts(), F.bool_or("truncated").alias("truncated"))


def observe_ticks(df: DataFrame, to: Observation | str) -> DataFrame:
    """The rows as they are; their counts of TICK go to the observation, of a stream to each batch's progress under that name."""
    return df.observe(to, *tick_counts())


def stored_sql(df: DataFrame) -> DataFrame:
    """Text that the literal policy allows; a masked text that still has literals degrades to none, and no text stays none."""
    masked = F.when(F.col("mask_ok") & F.col("sql_text").isNotNull(), F.col("canonical"))
    text = F.when(F.col("literal_policy") == "masked", masked).when(F.col("literal_policy").isin("full", "full_restricted"), F.col("sql_text"))
    return df.withColumns({"stored_sql": text, "masking_degraded": (F.col("literal_policy") == "masked") & ~F.coalesce(F.col("mask_ok"), F.lit(False))})


def with_plan(df: DataFrame, limit: int = PLAN_LIST) -> DataFrame:
    return df.filter("has_plan").orderBy(F.desc("order_key"), "instance_id").limit(limit)


def probe_targets(df: DataFrame, plan_limit: int = PLANS) -> DataFrame:
    """Probes of each tick: the longest that want a plan, then rows without a key; the latter are written first."""
    tick = Window.partitionBy("instance_id", "tick_ms")
    longest = [F.desc("duration_ms"), F.col("thread_id")]
    rows = df.withColumn("for_plan", F.col("wants_plan") & (F.row_number().over(tick.orderBy(F.desc("wants_plan"), *longest)) <= min(plan_limit, PROBES - PLANS)))
    room = F.lit(PROBES) - F.count_if("for_plan").over(tick)
    keyless = ~F.col("has_key") & ~F.col("for_plan")
    rows = rows.withColumns({"keyless": keyless, "room": room}).withColumn("nth", F.row_number().over(tick.orderBy(F.desc("keyless"), *longest)))
    rows = rows.filter(F.col("for_plan") | F.col("keyless") & (F.col("nth") <= F.col("room")))
    return rows.withColumn("write_order", F.row_number().over(tick.orderBy("for_plan", *longest))).drop("keyless", "room", "nth")


def live_tail(df: DataFrame, limit: int = TAIL) -> DataFrame:
    """Newest records by first arrival, each in its latest version."""
    latest = df.groupBy("record_id").agg(F.min("captured_at_ms").alias("first_at_ms"), F.max_by("state", F.struct("captured_at_ms", "event_id")).alias("state"), F.max_by("duration_ms", F.struct("captured_at_ms", "event_id")).alias("duration_ms"))
    return latest.orderBy(F.desc("first_at_ms"), "record_id").limit(limit)


def attach_statement_metrics(finalized: DataFrame, history: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of the newest ended event of the same thread and digest; none for an unknown digest."""
    keys = ["instance_id", "thread_id", "app_digest"]
    last = history.filter(F.col("end_event_id").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*counters), "history_id").alias("m"))
    known = F.when(~F.col("app_digest").startswith(UNKNOWN), F.col("app_digest"))
    rows = finalized.withColumn("__d", known).join(last.withColumnRenamed("app_digest", "__d"), ["instance_id", "thread_id", "__d"], "left")
    return rows.select(*finalized.columns, *[F.col(f"m.{c}").alias(f"history_{c}") for c in counters])


def pick_target(pairs: DataFrame) -> DataFrame:
    """Stored record for each incoming one: a closing record prefers open ones; then same key, same start, nearest, key."""
    closed = (F.col("incoming_state") != "in_flight") & (F.col("state") != "in_flight")
    apart = F.abs(F.col("started_at_ms") - F.col("incoming_start_ms"))
    order = F.struct(closed, F.col("order_key") != F.col("incoming_key"), apart != 0, apart, "order_key", "candidate_id")
    return pairs.groupBy("incoming_id").agg(F.min_by("candidate_id", order).alias("candidate_id"), F.count(F.lit(1)).alias("candidates"))
