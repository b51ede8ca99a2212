"""Shared pieces: tables in the shared scratch folder and distributed order by an integer id."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; only a local session without one falls back to its own temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write as Parquet and read again: cuts the lineage, and a lost executor costs one task, not the chain."""
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more, and let the driver collect its garbage: with the
    plans that are gone, Spark's cleaner removes their shuffle files."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def release() -> None:
    """Hand freed memory back to the system, where the C library can: the driver's Python shares a limit with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_caches: dict[str, Callable[[], None]] = {}


def cached(owner: str, clear: Callable[[], None]) -> None:
    """What a worker keeps from task to task for the stages of ``owner``, by the function that empties it."""
    _caches[owner] = clear


def leave(owner: str = "") -> None:
    """Empty the caches of all other owners and hand memory back."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
    release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. A Python worker serves one stage after the other: what an earlier one left in it goes
    before the first row, what this one leaves after the last, so that stages do not add up in an executor's memory."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave(owner)
        yield from run(batches)
        leave(owner)

    return within


def sliced(batches, rows: int = 500):
    """Arrow batches in small slices, so that a worker holds few texts as Python strings at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_buckets(df: DataFrame, key: str, buckets: int, segments: int = 64) -> Column:
    """Bucket number that grows with the integer ``key``: quantile segments, equal widths within each.

    Rows with smaller keys are in smaller buckets, equal keys share one; nulls go to bucket -1. Only
    ``segments`` + 1 quantiles reach the driver.
    """
    marks = [i / segments for i in range(segments + 1)]
    row = df.agg(F.percentile_approx(key, F.array(*map(F.lit, marks)), 1000).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if row is None or row["lo"] is None:
        return F.lit(-1).cast("bigint")
    cuts = sorted({*row["q"], row["lo"]} | {row["hi"] + 1})
    each = max(1, buckets // max(1, len(cuts) - 1))
    c = F.col(key).cast("double")
    out = F.lit(-1).cast("bigint")
    lows = F.array(*[F.lit(float(x)) for x in cuts])
    seg = F.size(F.filter(lows, lambda x: x <= c)).cast("int")
    lo, hi = F.element_at(lows, seg), F.element_at(lows, F.least(seg + 1, F.lit(len(cuts))))
    within = F.floor((c - lo) / F.greatest(hi - lo, F.lit(1.0)) * each)
    return F.when(F.col(key).isNotNull(), (seg - 1).cast("bigint") * each + F.least(within, F.lit(each - 1))).otherwise(out)
