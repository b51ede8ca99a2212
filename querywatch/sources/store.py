"""Stored executions, incremental reads and tiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from querywatch.operators.identity import merge_observations

#: Days that records and the hot tier keep, overlap of incremental reads in ms.
KEEP_DAYS, HOT_DAYS, OVERLAP_MS = 35, 31, 5000
DAY_MS = 86_400_000
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys")


def resume_window(checkpoints: DataFrame, now_ms: int, initial_ms: int, most_ms: int) -> DataFrame:
    """Where each log read starts: at its checkpoint, at most ``most_ms`` back (the skipped span is told), else ``initial_ms`` back."""
    floor = F.lit(now_ms - most_ms).cast("bigint")
    start = F.when(F.col("checkpoint_ms").isNull(), F.lit(now_ms - initial_ms).cast("bigint")).otherwise(F.greatest("checkpoint_ms", floor))
    return checkpoints.withColumns({"from_ms": start, "skipped_ms": F.greatest(F.coalesce(floor - F.col("checkpoint_ms"), F.lit(0)), F.lit(0))})


def read_digest_snapshots(df: DataFrame, last_success_ms: int) -> DataFrame:
    """Snapshots seen since the last success, with an overlap, outside the system schemas."""
    return df.filter((F.col("last_seen_ms") >= last_success_ms - OVERLAP_MS) & (F.col("schema_name").isNull() | ~F.lower("schema_name").isin(*SYSTEM_SCHEMAS)))


def read_status(samples: list[DataFrame], names: list[str]) -> DataFrame:
    """Long (variable_name, variable_value) samples of several sources to one wide row by instance and time."""
    rows = samples[0]
    for more in samples[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("instance_id", "at_ms", F.lower("variable_name").alias("name"), F.col("variable_value").try_cast("double").alias("value"))
    return rows.groupBy("instance_id", "at_ms").pivot("name", names).agg(F.max("value"))


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function from texts to its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _of_days(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """What a store has of the days of ``rows``; a year of days prunes by a list, more by a join."""
    days = [r[0] for r in rows.select("date_part").distinct().limit(367).collect()]
    return stored.filter(F.col("date_part").isin(days)) if len(days) < 367 else stored.join(rows.select("date_part").distinct(), "date_part", "left_semi")


def write_executions(df: DataFrame, path: str, batch: str | int | None = None) -> DataFrame:
    """Folds observations into a store of records: one for each (day, instance, record_id), merged field by field (``merge_observations``).

    Only the days of ``df`` are read and replaced. The result is the same in whatever order and split observations come, with one
    exception: a text that a policy has ruled out is not kept for a policy that turns up later, but was set earlier. The merged days
    are written beside the store first, so a writer that is lost at any point loses nothing: the next call with that ``batch`` takes
    them from there. A batch that is done is done once, however often it is written. One writer at a time for each store.
    """
    spark = df.sparkSession
    fs, at = _files(spark, path)
    name = uuid.uuid4().hex if batch is None else batch
    done, staged = at(f"{path}/_batches/{name}"), f"{path}/_staged/{name}"
    keys = ["date_part", "instance_id", "record_id"]
    if not fs.exists(done):
        if not fs.exists(at(f"{staged}/_SUCCESS")):
            new = merge_observations(df, keys)
            there = fs.exists(at(path)) and any(not f.getPath().getName().startswith("_") for f in fs.listStatus(at(path)))
            # the days are those of the observations, whose merged records need not be made for that
            merged = merge_observations(_of_days(spark.read.schema(new.schema).parquet(path), df).unionByName(new), keys).select(*new.columns) if there else new
            merged.write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_part").parquet(path)
        fs.create(done, True).close()
        fs.delete(at(staged), True)
    return spark.read.parquet(path).withColumn("date_part", F.col("date_part").cast("string"))


def apply_retention(df: DataFrame, now_ms: int, days: int = KEEP_DAYS) -> DataFrame:
    """Records younger than ``days``; whole days prune by date_part."""
    least = now_ms - days * DAY_MS
    out = df.filter(F.col("started_at_ms") > least)
    return out.filter(F.col("date_part") >= F.date_format(F.timestamp_millis(F.lit(least)), "yyyy-MM-dd")) if "date_part" in df.columns else out


def route_tier(hot: DataFrame, cold: DataFrame, from_ms: int, to_ms: int, boundary_ms: int) -> DataFrame:
    """Rows of a range from the hot tier (from the boundary on) and the cold one; a side outside the range is not read."""
    at, parts = F.col("started_at_ms"), []
    if to_ms >= boundary_ms:
        parts.append(hot.filter(at.between(max(from_ms, boundary_ms), to_ms)).withColumn("tier", F.lit("hot")))
    if from_ms < boundary_ms:
        parts.append(cold.filter(at.between(from_ms, min(to_ms, boundary_ms - 1))).withColumn("tier", F.lit("cold")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
