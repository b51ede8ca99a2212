"""Which observations are one execution, and what the record of it is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: How far starts of one execution may differ, and how far partners are searched, in ms.
SAME_START_MS, SEARCH_MS = 1000, 2000
PLACEHOLDER = "unknown-"


def placeholder(digest: Column) -> Column:
    return digest.isNull() | digest.startswith(PLACEHOLDER)


def match_same_execution(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` with its nearest partner in ``right``: same thread, digests that agree, spans that overlap.

    Spans that only touch are two runs, one after the other. The interval condition becomes an equi-join on buckets of the search window; the right side is in three of them.
    """
    bucket = lambda c: F.floor(F.col(c) / SEARCH_MS)
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in ("event_id", "instance_id", "thread_id", "started_at_ms", "duration_ms", "app_digest")]).withColumn("bucket", bucket("a_started_at_ms"))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in ("event_id", "instance_id", "thread_id", "started_at_ms", "duration_ms", "app_digest")])
    b = b.withColumn("bucket", F.explode(F.sequence(bucket("b_started_at_ms") - 1, bucket("b_started_at_ms") + 1)))
    end = lambda s: F.col(f"{s}_started_at_ms") + F.col(f"{s}_duration_ms")
    apart = F.abs(F.col("a_started_at_ms") - F.col("b_started_at_ms"))
    on = (F.col("a_instance_id") == F.col("b_instance_id")) & (F.col("a_thread_id") == F.col("b_thread_id")) & (a["bucket"] == b["bucket"])
    same = (F.col("a_app_digest") == F.col("b_app_digest")) | placeholder(F.col("a_app_digest")) | placeholder(F.col("b_app_digest"))
    overlap = (F.col("a_started_at_ms") < end("b")) & (F.col("b_started_at_ms") < end("a"))
    pairs = a.join(b, on & same & overlap & (apart <= SAME_START_MS))
    return pairs.groupBy(F.col("a_event_id").alias("event_id")).agg(F.min_by("b_event_id", F.struct(apart, "b_event_id")).alias("partner_id"), F.min(apart).alias("apart_ms"))


def state_rank(state: Column) -> Column:
    return F.when(state == "finalized", 2).when(state == "abandoned", 1).otherwise(0)


#: Columns that a record takes from its other rows where it has none, and those of them that a process list cannot know.
FILLED, MEASURED = ("sql_text", "schema_name", "db_user", "abandoned_reason", "lock_wait"), ("rows_examined", "rows_sent", "lock_time_ms")


def dedupe_records(df: DataFrame) -> DataFrame:
    """One row per record id: closed before open, exact before polled, with a plan before without, longer before shorter (then the lower event_id).

    What it lacks comes from the best other row that has it; measured rows and locks not from process lists. ``collapsed``
    counts the other rows. Columns that the table does not have are left out.
    """
    has_plan = F.col("has_plan").cast("int") if "has_plan" in df.columns else F.lit(0)
    rank = F.struct(state_rank(F.col("state")), F.col("capture_source").isin("slowlog", "merged").cast("int"), has_plan, F.col("duration_ms"), -F.col("event_id"))
    own = [c for c in ("event_id", "state", "capture_source", "duration_ms", "app_digest") if c in df.columns]
    fill = [c for c in (*FILLED, *MEASURED) if c in df.columns]
    measured = F.col("capture_source") != "processlist"
    other = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (measured if c in MEASURED else F.lit(True)), rank))
    out = df.groupBy("record_id").agg(F.max_by(F.struct(*own, *fill), rank).alias("best"), *[other(c).alias(f"other_{c}") for c in fill], (F.count(F.lit(1)) - 1).alias("collapsed"))
    return out.select("record_id", *[f"best.{c}" for c in own], *[F.coalesce(f"best.{c}", f"other_{c}").alias(c) for c in fill], "collapsed")


#: Orders in which one observation's value goes before another's.
SOURCES = ("polled", "timer", "span", "slowlog")  # of equal durations, the last
POLICIES = ("full", "full_restricted", "masked", "off")  # of policies set at one time, the last
STATEMENTS = ("select", "insert", "update", "delete", "replace", "ddl")  # the first; anything else is a place-holder
PLAN_SOURCES = ("none", "rerun_as_select", "rerun", "for_connection")  # the last

LEAST = ("record_id", "instance_id", "cluster_id", "env", "engine", "thread_id", "schema_name", "db_user", "db_host", "mysql_digest", "owner_worker", "abandoned_reason", "started_at_ms", "started_at_ms_precise", "captured_at_ms")
MOST, ANY = ("owner_epoch", "last_seen_at_ms"), ("is_nested", "long_running")


def _place(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.coalesce(value, F.lit(names[0])))


def _durations(df: DataFrame, one: Column) -> dict[str, Column]:
    """A measured duration, else the span to the latest valid end, else the longest seen, with where it is from."""
    own = F.col("duration_source") if "duration_source" in df.columns else F.when(F.col("capture_source") == "slowlog", "slowlog").otherwise("polled")
    exact = F.max(F.when(own == "slowlog", F.col("duration_ms")))
    stop = F.max(F.when(F.col("ended_at_ms") >= F.col("started_at_ms"), F.col("ended_at_ms")))
    precise = F.min("started_at_ms_precise") if "started_at_ms_precise" in df.columns else F.lit(None).cast("bigint")
    span = F.coalesce(F.when(stop >= precise, stop - precise), F.when(stop >= F.min("started_at_ms"), stop - F.min("started_at_ms")))
    longest = F.max(F.struct(F.col("duration_ms").alias("d"), _place(own, SOURCES), own.alias("s")))
    return {
        "ended_at_ms": F.when(one, F.max("ended_at_ms")).otherwise(stop),
        "duration_ms": F.when(one, F.max("duration_ms")).otherwise(F.coalesce(exact, span, longest["d"])),
        "duration_source": F.when(one, F.max(own)).when(exact.isNotNull(), "slowlog").when(span.isNotNull(), "span").otherwise(longest["s"]),
    }


def _texts(df: DataFrame, one: Column, policy: Column) -> dict[str, Column]:
    """The longest text that the policy allows, and what is said of it; a text with literals never passes a policy without."""
    cut, lossy = (F.col(c) if c in df.columns else F.lit(False) for c in ("sql_text_truncated", "sql_text_lossy"))
    open_ = ("full", "full_restricted")

    def longest(allowed: Column) -> Column:
        size = -F.octet_length("sql_text")
        best = lambda v: F.min(F.when(allowed & F.col("sql_text").isNotNull(), F.struct(size, v.alias("v"))))["v"]  # noqa: E731  of equally long texts the least, and flags that all have
        return F.struct(best(F.col("sql_text")).alias("text"), best(cut).alias("cut"), best(lossy).alias("lossy"))

    kept = F.when(one | policy.isin(*open_), longest(F.lit(True))).when(policy == "masked", longest(~F.col("literal_policy").isin(*open_)))
    out = {"sql_text": kept["text"], "sql_text_truncated": F.coalesce(kept["cut"], F.lit(False)), "sql_text_lossy": F.coalesce(kept["lossy"], F.lit(False))}
    return {k: v for k, v in out.items() if k in df.columns}


def _plan(fields: list[str]) -> Column:
    """Field by field from the best source that has it; an error only if the best has no plan."""
    there = F.col("plan.normalized_json").isNotNull() | F.col("plan.s3_key").isNotNull()
    rank = F.struct(_place(F.col("plan.source"), PLAN_SOURCES), there, -F.col("captured_at_ms"))
    best = lambda f: F.max_by(F.col(f"plan.{f}"), F.when(F.col(f"plan.{f}").isNotNull(), rank))
    special = {"error": F.when(~F.max_by(there, rank), best("error")), "referenced_tables": F.array_sort(F.array_distinct(F.flatten(F.collect_list("plan.referenced_tables"))))}
    return F.struct(*[special.get(f, best(f)).alias(f) for f in fields])


def merge_observations(df: DataFrame, by: str | list[str] = "execution_id") -> DataFrame:
    """All observations of an execution as one record, field by field and in any order of arrival; records are observations, too.

    The earliest start, the latest valid end, the policy that was set first (of equals the strictest), the longest text
    that it allows, real digests and statement types before place-holders, the largest counters, the best plan, the
    last lock wait. A single observation passes through as it is. Columns that the table does not have are left out.
    """
    keys = [by] if isinstance(by, str) else by
    has, one = set(df.columns) - set(keys), F.count(F.lit(1)) == 1
    out = {c: F.min(c) for c in LEAST if c in has} | {c: F.max(c) for c in MOST if c in has} | {c: F.bool_or(c) for c in ANY if c in has}
    if {"record_id", "captured_at_ms"} <= has:
        out["record_id"] = F.min_by("record_id", F.struct("captured_at_ms", "record_id"))  # a late twin does not rename a record
    out |= _durations(df, one) | {"state": F.max_by("state", state_rank(F.col("state"))), "capture_source": F.when(F.min("capture_source") != F.max("capture_source"), "merged").otherwise(F.min("capture_source"))}  # no distinct count: rows are dealt once
    version = F.col("digest_algo_version") if "digest_algo_version" in has else F.lit(0)
    digest = F.min(F.struct(placeholder(F.col("app_digest")), -version, F.col("app_digest").alias("digest"), version.alias("version")))
    out |= {"app_digest": digest["digest"]} | ({"digest_algo_version": digest["version"]} if "digest_algo_version" in has else {})
    if "engine_version" in has:
        out["engine_version"] = F.coalesce(F.min(F.when(F.col("engine_version") != "", F.col("engine_version"))), F.min("engine_version"))
    if "statement_type" in has:
        place = F.array_position(F.array(*map(F.lit, STATEMENTS)), F.col("statement_type"))
        out["statement_type"] = F.coalesce(F.min_by("statement_type", F.when(place > 0, place)), F.lit("other"))
    policy = F.lit("full")
    if "literal_policy" in has:
        set_first = F.min(F.struct("literal_policy_at_ms", -_place(F.col("literal_policy"), POLICIES), "literal_policy"))
        policy = set_first["literal_policy"]
        out |= {"literal_policy": policy, "literal_policy_at_ms": set_first["literal_policy_at_ms"]}
        out |= _texts(df, one, policy)
    if "stats" in has:
        out["stats"] = F.struct(*[F.max(f"stats.{f.name}").alias(f.name) for f in df.schema["stats"].dataType.fields])  # of flags: any
    if "plan" in has:
        out["plan"] = _plan(df.schema["plan"].dataType.fieldNames())
    if "lock_wait" in has:
        last = F.max("lock_wait")
        out["lock_wait"] = F.when(last.isNotNull() & (policy == "off"), last.withField("blocking_statements", F.array().cast("array<string>"))).otherwise(last)
    many = F.sum(F.coalesce("observations", F.lit(1))) if "observations" in has else F.count(F.lit(1))
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in out.items()], many.cast("bigint").alias("observations"))


TWIN = "instance_id string, thread_id bigint, event_id bigint, collapsed bigint"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each piece in start order against the kept rows that started within the search window.

    The better row of a pair takes the kept one's place. Only kept rows inside the window are in memory.
    """
    at, kept = None, []
    for batch in batches:
        out = []
        for instance, thread, piece, event, start, duration, digest, unknown, *rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (instance, thread, piece) != at:
                out.extend(x[:4] for x in kept)
                at, kept = (instance, thread, piece), []
            out.extend(x[:4] for x in kept if start - x[4] > SEARCH_MS)
            kept = [x for x in kept if start - x[4] <= SEARCH_MS]
            view = [instance, thread, event, 0, start, duration, digest, unknown, (*rank, duration)]
            for i, x in enumerate(kept):
                if abs(start - x[4]) <= SAME_START_MS and (digest == x[6] or unknown or x[7]) and start < x[4] + x[5] and x[4] < start + duration:
                    best = x if x[8] >= view[8] else view
                    best[3] = x[3] + 1
                    kept[i] = best
                    break
            else:
                kept.append(view)
        yield _twins(out)
    yield _twins([x[:4] for x in kept])


def _twins(out: list) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["instance_id", "thread_id", "event_id", "collapsed"])


def collapse_twins(df: DataFrame) -> DataFrame:
    """Greedy scan of each thread in start order: a record that is one execution with a kept one within the search
    window is merged into it, whatever lies between; of the two, the record that closed, was measured and ran
    longest stays, the earlier one of equals. One row per kept record.

    No pair can match across a gap wider than the search window, so cutting there is exact. Pieces are sorted by
    Spark and streamed, so a long one costs time in its task, but no memory beyond its window.
    """
    w = Window.partitionBy("instance_id", "thread_id").orderBy("started_at_ms", "event_id")
    gap = F.col("started_at_ms") - F.lag("started_at_ms").over(w) > SEARCH_MS
    df = df.withColumn("piece", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w))
    unknown = placeholder(F.col("app_digest"))
    rows = df.repartition("instance_id", "thread_id", "piece").sortWithinPartitions("instance_id", "thread_id", "piece", "started_at_ms", "event_id")
    rows = rows.select(
        F.col("instance_id").cast("string"), F.col("thread_id").cast("bigint"), "piece", F.col("event_id").cast("bigint"), F.col("started_at_ms").cast("bigint"),
        F.coalesce(F.col("duration_ms").cast("bigint"), F.lit(0)), "app_digest", unknown, F.coalesce(state_rank(F.col("state")), F.lit(0)), F.coalesce(F.col("capture_source").isin("merged", "slowlog").cast("int"), F.lit(0)),
    )
    return rows.mapInArrow(_fold, TWIN)
