"""Statistics and listings over execution records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Duration buckets in ms, unmeasured capture, page sizes.
BUCKETS = ((5_000, "b0"), (15_000, "b1"), (60_000, "b2"))
LAST_BUCKET = "b3"
PAGE, PAGE_MOST = 50, 500


def duration_bucket(ms: Column) -> Column:
    out = F.lit(LAST_BUCKET)
    for limit, name in reversed(BUCKETS):
        out = F.when(ms < limit, name).otherwise(out)
    return out


def derive_keys(df: DataFrame) -> DataFrame:
    """record_id, date_part, hour_bucket, dur_bucket and the textual order key."""
    ts = F.timestamp_millis("started_at_ms")
    return df.withColumns({
        "record_id": F.concat_ws(":", "instance_id", F.col("thread_id").cast("string"), F.floor(F.col("started_at_ms") / 1000).cast("string")),
        "date_part": F.date_format(ts, "yyyy-MM-dd"), "hour_bucket": F.date_format(ts, "yyyy-MM-dd'T'HH"), "dur_bucket": duration_bucket(F.col("duration_ms")),
        "order_key": F.concat_ws("#", F.lpad(F.col("started_at_ms").cast("string"), 13, "0"), F.col("thread_id").cast("string")),
    })


def time_range(df: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Inclusive range; a date_part column is bounded too, so that partitions prune."""
    out = df.filter(F.col("started_at_ms").between(from_ms, to_ms))
    if "date_part" in df.columns:
        day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd")
        out = out.filter(F.col("date_part").between(day(from_ms), day(to_ms)))
    return out


def month_range(df: DataFrame, month: str, offset: str = "+09:00") -> DataFrame:
    """Calendar month ``YYYY-MM`` at a fixed offset, up to one millisecond before the next."""
    start = F.unix_millis(F.to_timestamp(F.lit(f"{month}-01T00:00:00{offset}")))
    end = F.unix_millis(F.to_timestamp(F.lit(f"{month}-01T00:00:00{offset}")) + F.expr("interval 45 days"))
    rows = df.withColumn("__m", F.date_format(F.timestamp_millis(F.col("started_at_ms")) + F.expr(f"interval '{offset[1:]}' hour to minute") * (1 if offset[0] == "+" else -1), "yyyy-MM"))
    return rows.filter((F.col("started_at_ms") >= start) & (F.col("started_at_ms") < end) & (F.col("__m") == month)).drop("__m")


def env_scope(df: DataFrame, requested: list[str] | None, allowed: list[str]) -> DataFrame:
    """Rows of the requested and allowed environments; none if they do not meet."""
    return df.filter(F.col("env").isin([e for e in allowed if requested is None or e in requested]))


def instance_match(df: DataFrame, like: str = "", exact: str | None = None) -> DataFrame:
    out = df.filter(F.lower("instance_id").contains(like.strip().lower()))
    return out if exact is None else out.filter(F.col("instance_id") == exact)


def redact(df: DataFrame, role: str) -> DataFrame:
    """Hide SQL by literal policy and role, with the reason. Restricted literals need the admin role."""
    reason = F.when(F.col("literal_policy") == "off", "policy_off").when((F.col("literal_policy") == "full_restricted") & F.lit(role != "admin"), "restricted")
    return df.withColumn("redaction", reason).withColumn("sql_text", F.when(F.col("redaction").isNull(), F.col("sql_text")))


def preview(df: DataFrame) -> DataFrame:
    """Public columns; SQL only under the masked policy."""
    return df.select("instance_id", "started_at_ms", "duration_ms", "statement_type", F.when(F.col("literal_policy") == "masked", F.col("sql_text")).alias("sql_text"))


def lock_victim(df: DataFrame) -> DataFrame:
    """At least half of the time went to locks."""
    return df.withColumn("lock_victim", (F.col("duration_ms") > 0) & (F.col("lock_time_ms") * 2 >= F.col("duration_ms")))


def display_duration(df: DataFrame, now_ms: int) -> DataFrame:
    running = F.col("duration_ms") + F.greatest(F.lit(0).cast("bigint"), F.lit(now_ms).cast("bigint") - F.col("started_at_ms") - F.col("duration_ms"))
    return df.withColumn("shown_ms", F.when(F.col("state") == "in_flight", running).otherwise(F.col("duration_ms")))


def statement_kind(df: DataFrame) -> Column:
    """read, write, ddl, commit or other."""
    t = F.col("statement_type")
    commit = F.lower(F.ltrim(F.coalesce(F.col("sql_text"), F.lit("")))).startswith("commit")
    return F.when(t == "select", "read").when(t.isin("insert", "update", "delete", "replace"), "write").when(t == "ddl", "ddl").when(commit, "commit").otherwise("other")


def _measured() -> Column:
    """A process-list capture has not measured rows, even if it says 0."""
    return F.when(F.col("capture_source") != "processlist", F.col("rows_examined"))


def digest_stats(df: DataFrame) -> DataFrame:
    """Per instance and digest. The representative SQL is the newest visible one."""
    key = F.struct("started_at_ms", "event_id") if "event_id" in df.columns else F.struct("started_at_ms", "thread_id")
    shown = F.col("sql_text").isNotNull()
    return df.groupBy("instance_id", "app_digest").agg(
        F.count(F.lit(1)).alias("executions"), F.sum("duration_ms").alias("total_ms"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
        F.round(F.avg(_measured()), 6).alias("avg_rows_examined"), F.min("started_at_ms").alias("first_seen_ms"), F.max("started_at_ms").alias("last_seen_ms"),
        F.array_join(F.array_sort(F.collect_set("db_user")), ",").alias("users"), F.max_by("sql_text", F.when(shown, key)).alias("sql_text"), F.max_by("statement_type", key).alias("statement_type"),
    )


def _kinds(df: DataFrame) -> list[Column]:
    return [F.count_if(statement_kind(df) == k).alias(f"n_{k}") for k in ("read", "write", "ddl", "commit", "other")]


def instance_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("instance_id").agg(
        F.count_distinct("app_digest").alias("digests"), F.count(F.lit(1)).alias("executions"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
        F.coalesce(F.sum(_measured()), F.lit(0)).alias("rows_examined"), *_kinds(df), F.min("started_at_ms").alias("first_seen_ms"), F.max("started_at_ms").alias("last_seen_ms"),
    )


def user_stats(df: DataFrame) -> DataFrame:
    """Rows without a user are left out."""
    return df.filter(F.col("db_user").isNotNull()).groupBy("instance_id", "db_user").agg(
        F.count(F.lit(1)).alias("executions"), F.count_distinct("app_digest").alias("digests"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), *_kinds(df)
    )


def page_after(df: DataFrame, position: tuple[str, str] | None, limit: int = PAGE) -> DataFrame:
    """Keyset page in the total order (order_key desc, instance asc), strictly after the position.

    Every row says whether more rows follow, and the last one then has the position that the next page starts from. The range of
    the first page is the caller's to keep: filter by it before.
    """
    if position:
        key, instance = position
        df = df.filter((F.col("order_key") < key) | (F.col("order_key") == key) & (F.col("instance_id") > instance))
    n, order = min(limit, PAGE_MOST), (F.desc("order_key"), "instance_id")
    top = df.orderBy(*order).limit(n + 1)  # all that the windows below see
    rows = top.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > n}).filter(F.col("place") <= n)
    return rows.withColumn("next_position", F.when(F.col("has_more") & (F.col("place") == n), F.concat("order_key", F.lit("|"), "instance_id"))).drop("place")


def in_flight(df: DataFrame, limit: int) -> DataFrame:
    return df.filter("state = 'in_flight'").orderBy("started_at_ms", "instance_id", "thread_id").limit(limit)


def fair_share(df: DataFrame, ceiling: int, order: list[Column], rounds: int = 2) -> DataFrame:
    """At most ``ceiling`` rows, shared evenly over instances; what some leave goes to those that hit their share."""
    counts = df.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()  # a row per instance
    counts = counts.withColumn("share", F.least("n", F.floor(F.lit(ceiling) / F.count(F.lit(1)).over(all_))))
    for _ in range(rounds):
        hungry = F.col("n") > F.col("share")
        left = F.lit(ceiling) - F.sum("share").over(all_)
        wanting = F.greatest(F.sum(hungry.cast("int")).over(all_), F.lit(1))
        counts = counts.withColumn("share", F.when(hungry, F.least("n", F.col("share") + F.floor(left / wanting))).otherwise(F.col("share")))
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("instance_id").orderBy(*order))).filter(F.col("rn") <= ceiling)  # no share is larger: tasks cut before they shuffle
    return ranked.join(counts, "instance_id").filter("rn <= share").withColumn("truncated", F.col("n") > F.col("share")).drop("rn", "n", "share")


def orphans(df: DataFrame, now_ms: int, silent_ms: int = 210_000) -> DataFrame:
    """Open records that nobody has touched for too long become abandoned; the end stays unknown."""
    seen = F.col("started_at_ms") + F.col("duration_ms")
    gone = (F.col("state") == "in_flight") & (F.lit(now_ms) - seen > silent_ms)
    return df.withColumns({"state": F.when(gone, "abandoned").otherwise(F.col("state")), "abandoned_reason": F.when(gone, "owner_lost")})


def close_paused(rows: DataFrame, pauses: DataFrame) -> DataFrame:
    """Open rows of paused targets that began before the pause did: abandoned, collector_paused; all others are left out.

    Pauses have a scope (all, env:<env>, cluster:<id> or id:<instance>) and since_ms; of several the latest counts. Rows may be a
    stream: the pauses are joined as they are when a batch runs.
    """
    last = pauses.groupBy("scope").agg(F.max("since_ms").alias("since_ms"))
    id_ = F.col("instance_id")
    keys = {"all": F.concat(F.lit("all"), F.substring(id_, 1, 0))} | {k: F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in (("env", "env"), ("cluster", "cluster_id"), ("id", "instance_id")) if c in rows.columns}
    out = rows.filter(F.col("state") == "in_flight")
    for kind, key in keys.items():  # a left join for each kind of scope: no row doubles, and a stream needs no state
        one = last.filter(F.col("scope").startswith(kind)).select(F.col("scope").alias(f"__{kind}"), F.col("since_ms").alias(f"__since_{kind}"))
        out = out.withColumn(f"__{kind}", key).join(one, f"__{kind}", "left")
    since = [F.col(f"__since_{k}") for k in keys]
    out = out.filter(F.col("started_at_ms") < F.greatest(*since)).select(*[c for c in rows.columns if c not in ("state", "abandoned_reason")], F.lit("abandoned").alias("state"), F.lit("collector_paused").alias("abandoned_reason"))
    return out
