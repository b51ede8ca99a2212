"""Streaming counters: hourly sums and their rollups, and status rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from querywatch.operators.counters import hourly_sums, merge_sums, top_of_hours

HOUR_MS = 3_600_000


def rollup_stream(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hours per instance and digest (columns at, instance_id, app_digest, duration_ms)."""
    return events.withWatermark("at", delay).groupBy(F.window("at", "1 hour"), "instance_id", "app_digest").agg(F.count(F.lit(1)).alias("executions"), F.sum("duration_ms").alias("time_ms"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def flush_hours(batch: DataFrame, number: int, path: str, delay_ms: int, top_n: int, threshold_ms: int) -> None:
    """One batch of deltas (columns as ``counters.hourly_rollup`` takes them) into the folders below ``path``.

    ``open``: sums of each batch by hour; ``late``: rows whose hour was closed before; ``seen``: the latest time of each batch;
    ``rollup``: closed hours. Every folder is written by batch or by hour, so a batch that is tried again replaces what it wrote.
    """
    spark = batch.sparkSession
    overwrite = lambda df, to, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{to}")
    before = spark.read.parquet(f"{path}/seen").filter(F.col("batch") < number).agg(F.max("at_ms")).first()[0] if _there(spark, f"{path}/seen") else None
    shut = -1 if before is None else before - delay_ms  # hours that end by then were closed by an earlier batch
    ends = (F.floor((F.col("snapshot_ms") - 1) / HOUR_MS) + 1) * HOUR_MS
    rows = batch.withColumns({"ends_ms": ends.cast("bigint"), "batch": F.lit(number).cast("bigint")})
    overwrite(rows.filter(F.col("ends_ms") <= shut), "late", "batch")
    sums = hourly_sums(rows.filter(F.col("ends_ms") > shut)).withColumns({"batch": F.lit(number).cast("bigint"), "ends_ms": (F.unix_millis(F.to_timestamp("hour", "yyyy-MM-dd'T'HH")) + HOUR_MS)})
    overwrite(sums, "open", "ends_ms", "batch")
    latest = batch.agg(F.max("snapshot_ms").alias("at_ms")).select(F.greatest("at_ms", F.lit(before).cast("bigint")).alias("at_ms"), F.lit(number).cast("bigint").alias("batch"))
    overwrite(latest, "seen", "batch")
    now = spark.read.parquet(f"{path}/seen").filter(F.col("batch") == number).first()["at_ms"]
    if now is None or not _there(spark, f"{path}/open"):
        return
    held = spark.read.schema(sums.schema).parquet(f"{path}/open")
    closed = held.filter((F.col("ends_ms") > shut) & (F.col("ends_ms") <= now - delay_ms) & (F.col("batch") <= number))
    overwrite(top_of_hours(merge_sums(closed), top_n, threshold_ms).withColumn("ends_ms", F.unix_millis(F.to_timestamp("hour", "yyyy-MM-dd'T'HH")) + HOUR_MS), "rollup", "ends_ms")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/open")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for hour in fs.listStatus(fs_path):  # sums of hours that an earlier batch has closed
        name = hour.getPath().getName()
        if name.startswith("ends_ms=") and int(name.partition("=")[2]) <= shut:
            fs.delete(hour.getPath(), True)


def rollup_hours(deltas: DataFrame, path: str, delay_ms: int = 2 * HOUR_MS, top_n: int = 200, threshold_ms: int = 100) -> DataStreamWriter:
    """A writer that rolls hours up once each, when the latest delta is ``delay_ms`` past their end: path/rollup equals
    ``counters.hourly_rollup`` of all rows that came in time, path/late has the others, and path/seen how far the stream is.

    Late rows are kept, which a watermark of Spark would drop; so the sums of open hours stand in files, not in state. The session's
    time zone must be UTC, as for every hour here. Give the writer a checkpoint of its own and start it.
    """
    return deltas.writeStream.foreachBatch(lambda batch, number: flush_hours(batch, number, path, delay_ms, top_n, threshold_ms))


def status_stream(samples: DataFrame) -> DataFrame:
    """Rates from the previous sample that the state of each instance holds.

    A batch's samples are put in order; one that comes behind a later one of an earlier batch is told as non_monotonic_clock.
    """
    out = "instance_id string, at_ms bigint, gap_reason string, qps double"

    def rates(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for row in pd.concat(list(batches)).sort_values("at_ms").itertuples():
            gap = "first_sample" if last is None else "non_monotonic_clock" if row.at_ms <= last[0] else "counters_reset" if row.uptime_s < last[1] or row.queries < last[2] else None
            rows.append((key[0], row.at_ms, gap, None if gap else round((row.queries - last[2]) * 1000 / (row.at_ms - last[0]), 6)))
            last = (row.at_ms, row.uptime_s, row.queries)
        state.update(last)
        yield pd.DataFrame(rows, columns=["instance_id", "at_ms", "gap_reason", "qps"])

    return samples.groupBy("instance_id").applyInPandasWithState(rates, out, "at_ms long, uptime_s long, queries long", "append", "NoTimeout")
