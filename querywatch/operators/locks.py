"""Lock waits, transactions and pending metadata locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from querywatch.functions import query_text


#: The command of a session that runs nothing, and the parts of a thread that a report shows.
IDLE = "Sleep"
SESSION = ("processlist_id", "user", "host", "command", "time_s")


def _sessions(threads: DataFrame, prefix: str) -> DataFrame:
    return threads.select(F.col("thread_id").alias(f"{prefix}_thread_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in SESSION if c in threads.columns])


def _latest(statements: DataFrame, thread: str, name: str) -> DataFrame:
    return statements.groupBy(F.col("thread_id").alias(thread)).agg(F.max_by("sql_text", "statement_id").alias(name))


def lock_waits(waits: DataFrame, threads: DataFrame, statements: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Waits with both sessions and their latest statements; longest wait first.

    A wait whose session is gone is left out, one whose blocker is gone stays. With ``locks`` (engine_lock_id, engine, object_schema,
    object_name, index_name, lock_mode) a wait has the table, index and mode that it asks for, found by its own lock alone.
    """
    out = waits.join(_sessions(threads, "waiting"), "waiting_thread_id").join(_sessions(threads, "blocking"), "blocking_thread_id", "left")
    out = out.join(_latest(statements, "blocking_thread_id", "blocking_statement"), "blocking_thread_id", "left").join(_latest(statements, "waiting_thread_id", "waiting_statement"), "waiting_thread_id", "left")
    if locks is not None:
        name = F.when(F.col("object_schema").isNotNull(), F.concat_ws(".", "object_schema", F.when(F.col("object_name").isNotNull(), F.col("object_name")))).otherwise(F.col("object_name"))
        asked = locks.select(F.col("engine_lock_id").alias("requesting_lock_id"), "engine", F.when(F.col("object_name").isNotNull(), name).alias("locked_table"), F.col("index_name").alias("locked_index"), "lock_mode")
        out = out.join(asked, ["requesting_lock_id", "engine"], "left")
    return out.orderBy(F.desc("waiting_time_s"), "wait_id")


def lock_wait_report(waits: DataFrame, hidden: str | None = None) -> DataFrame:
    """Waits as they may be shown: statements are masked, those that cannot be are withheld and counted; blocking_idle tells a blocker that runs nothing.

    With ``hidden`` (a reason) no statement is shown at all.
    """

    def shown(c: str) -> Column:
        bare = lambda t: F.trim(F.regexp_replace(t, r"(?s)/\*\+.*?\*/ ?", ""))
        return F.transform(F.array(query_text.canonical(F.col(c))), lambda t: F.when(F.col(c).isNotNull() & query_text.mask_ok(t) & (bare(t) != ""), bare(t)))[0]

    texts = ("waiting_statement", "blocking_statement")
    kept = {c: F.lit(None).cast("string") if hidden else shown(c) for c in texts}
    lost = sum((F.when(F.col(c).isNotNull() & kept[c].isNull(), 1).otherwise(0) for c in texts), F.lit(0))
    return waits.withColumns({"blocking_idle": F.coalesce(F.col("blocking_command") == IDLE, F.lit(False)), "sql_withheld": F.lit(0) if hidden else lost, "sql_hidden": F.lit(hidden).cast("string")} | kept)


def transaction_statements(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements of each open transaction in event order."""
    rows = transactions.join(statements, ["thread_id", "transaction_id"])
    ordered = F.array_sort(F.collect_list(F.struct("statement_id", "sql_text")))
    return rows.groupBy("thread_id", "transaction_id").agg(F.array_join(ordered["sql_text"], "; ").alias("statements"), F.count(F.lit(1)).alias("n"))


def open_transactions(transactions: DataFrame, threads: DataFrame, least_s: int, limit: int) -> DataFrame:
    """Transactions of at least an age, oldest first; idle if the session runs nothing."""
    out = transactions.filter(F.col("age_s") >= least_s).join(threads.select("thread_id", "user", "time_s"), "thread_id", "left")
    return out.withColumn("idle", F.col("time_s").isNull() | (F.col("time_s") == 0)).orderBy(F.desc("age_s"), "transaction_id").limit(limit)


def metadata_lock_queue(locks: DataFrame, threads: DataFrame | None = None, statements: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """All locks on tables that someone waits for.

    With ``threads`` and ``statements``: their sessions and latest statements. By table, holders before waiters and the longest first, so that
    a ``limit`` cuts those at the end of the line, not who holds it up.
    """
    if "object_type" in locks.columns:
        locks = locks.filter("object_type = 'TABLE'")
    table = ["object_schema", "object_name"]
    out = locks.join(locks.filter("lock_status = 'PENDING'").select(*table).distinct(), table, "left_semi")
    if threads is not None:
        out = out.join(_sessions(threads, "owner"), "owner_thread_id")
    if statements is not None:
        out = out.join(_latest(statements, "owner_thread_id", "sql_text"), "owner_thread_id", "left")
    if limit is None:
        return out
    order = [*table, "lock_status", *([F.desc("owner_time_s")] if "owner_time_s" in out.columns else []), "owner_thread_id"]
    return out.orderBy(*order).limit(limit)


def lock_report(queue: DataFrame) -> DataFrame:
    return queue.groupBy("object_schema", "object_name").agg(F.count_if(F.col("lock_status") == "PENDING").alias("pending"), F.count_if(F.col("lock_status") == "GRANTED").alias("granted"))
