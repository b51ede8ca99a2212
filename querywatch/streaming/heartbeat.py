"""Signs of life for open runs that nothing has written for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Silence of an open run after which its record is touched, in ms, and touches of an instance at once.
SILENT_MS, MOST = 15_000, 200

OUT = "instance_id string, thread_id bigint, started_at_ms bigint, touched_at_ms bigint, silent_ms bigint"


class Heart(StatefulProcessor):
    """State of an instance: when each open run was touched last. One timer stands at the time when the first of them is due."""

    def __init__(self, silent_ms: int, most: int):
        self.silent_ms, self.most = silent_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.touched = handle.getMapState("touched", "thread_id bigint, started_at_ms bigint", "at_ms bigint")

    def due_at(self, now: int) -> None:
        times = [v[0] for v in self.touched.values()]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(min(times) + self.silent_ms, now + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for row in pd.concat(list(rows)).itertuples():
            run = (int(row.thread_id), int(row.started_at_ms))
            if row.state == "in_flight":
                self.touched.updateValue(run, (now,))
            elif self.touched.containsKey(run):
                self.touched.removeKey(run)
        self.due_at(now)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        silent = sorted((v[0], *k) for k, v in self.touched.iterator() if now - v[0] >= self.silent_ms)[: self.most]
        for _, thread, started in silent:
            self.touched.updateValue((thread, started), (now,))
        self.due_at(now)
        if silent:
            yield pd.DataFrame([(key[0], thread, started, now, now - at) for at, thread, started in silent], columns=["instance_id", "thread_id", "started_at_ms", "touched_at_ms", "silent_ms"])

    def close(self) -> None:
        pass


def heartbeat(runs: DataFrame, silent_ms: int = SILENT_MS, most: int = MOST) -> DataFrame:
    """A row for each open run of a stream (instance_id, thread_id, started_at_ms, state) that has brought no row for ``silent_ms``.

    Longest silent first and ``most`` of an instance at once; those that are left are due at the next trigger. A touch counts as
    one, so a run that stays silent comes again after the same time; a row in another state ends it. Timers are of processing time, so a
    restart goes on with the silence that was there. State lives in RocksDB, as for ``track_stream``.
    """
    return runs.select("instance_id", "thread_id", "started_at_ms", "state").groupBy("instance_id").transformWithStateInPandas(Heart(silent_ms, most), OUT, "append", "ProcessingTime")
