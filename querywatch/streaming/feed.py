"""What viewers are told live: rows by topic, and where a series has lost data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from querywatch.operators.counters import GAP_MS
from querywatch.operators.statistics import env_scope

GAPS = "instance_id string, metric string, from_ms bigint, to_ms bigint"


def live_feed(slow: DataFrame, status: DataFrame, asked: list[str], allowed: list[str]) -> DataFrame:
    """(topic, key, value): executions by environment, as far as a viewer asks for it and may see it, and status samples by instance.

    A row is JSON, as a message sink takes it, and the key keeps an instance's messages in order. Both sides may be streams.
    """
    shown = env_scope(slow, asked, allowed)
    rows = shown.select(F.concat(F.lit("slow/"), "env").alias("topic"), F.col("instance_id").alias("key"), F.to_json(F.struct(*shown.columns)).alias("value"))
    return rows.unionByName(status.select(F.concat(F.lit("status/"), "instance_id").alias("topic"), F.col("instance_id").alias("key"), F.to_json(F.struct(*status.columns)).alias("value")))


def gap_events(points: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """From where to where a series (instance_id, metric, at_ms) has no sample for more than ``gap_ms``."""
    before = F.lag("at_ms").over(Window.partitionBy("instance_id", "metric").orderBy("at_ms"))
    return points.withColumn("from_ms", before).filter(F.col("at_ms") - F.col("from_ms") > gap_ms).select("instance_id", "metric", "from_ms", F.col("at_ms").alias("to_ms"))


class Series(StatefulProcessor):
    """State of a series: its latest sample."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for at in sorted(pd.concat(list(rows))["at_ms"].astype("int64").tolist()):
            if last is not None and at - last > self.gap_ms:
                out.append((*key, last, at))
            last = at if last is None else max(last, at)
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["instance_id", "metric", "from_ms", "to_ms"])

    def close(self) -> None:
        pass


def gap_stream(points: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """The gaps of ``gap_events`` as they close, for samples that come in order batch by batch. One that comes behind a later batch fills no
    gap that was told, and tells none. State lives in RocksDB, as for ``track_stream``."""
    return points.select("instance_id", "metric", "at_ms").groupBy("instance_id", "metric").transformWithStateInPandas(Series(gap_ms), GAPS, "append", "None")
