"""Executions from streams of process-list sightings: the runs of ``operators.tracking`` as they end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from querywatch.operators.tracking import LONGEST_MS, RUN

#: Fixed value: open runs of an instance above which those that a tick lacks are given up, oldest first.
MOST_OPEN = 50_000

OUT = "instance_id string, thread_id bigint, started_at_ms bigint, duration_ms bigint, app_digest string, sightings bigint, last_seen_ms bigint, end_reason string, state string"
PENDING = "truncated boolean, threads array<bigint>, secs array<bigint>, digests array<string>, who array<string>"
OPEN = "first_seen_ms bigint, started_at_ms bigint, secs bigint, digest string, who string, sightings bigint, last_seen_ms bigint"


class Entry:
    """An open run, in the order of OPEN."""

    __slots__ = ("digest", "first_seen_ms", "last_seen_ms", "secs", "sightings", "started_at_ms", "who")

    def __init__(self, first_seen_ms, started_at_ms, secs, digest, who, sightings, last_seen_ms):
        self.first_seen_ms, self.started_at_ms, self.secs, self.digest, self.who, self.sightings, self.last_seen_ms = first_seen_ms, started_at_ms, secs, digest, who, sightings, last_seen_ms

    def values(self) -> tuple:
        return self.first_seen_ms, self.started_at_ms, self.secs, self.digest, self.who, self.sightings, self.last_seen_ms


def advance(open_: dict[int, Entry], tick_ms: int, truncated: bool, seen: dict[int, tuple[int, str | None, str]], most_open: int = MOST_OPEN) -> Iterator[tuple[int, Entry, str]]:
    """One tick of an instance: (thread, run, reason) of the runs that end. seen: thread to (seconds, digest, who).

    In this order: sightings, which continue a run or take its thread; absences, if the list is whole; runs that are too long;
    and, with more than ``most_open`` runs left, the oldest of those that this tick lacks. What a tick shows is never given up.
    """
    for thread, (secs, digest, who) in seen.items():
        e = open_.get(thread)
        if e is not None and e.who == who and secs >= e.secs and (digest is None or e.digest is None or digest == e.digest):
            e.secs, e.last_seen_ms, e.sightings, e.digest = secs, tick_ms, e.sightings + 1, e.digest if e.digest is not None else digest
            continue
        if e is not None:
            yield thread, e, "thread_reused"
        open_[thread] = Entry(tick_ms, tick_ms - secs * 1000, secs, digest, who, 1, tick_ms)
    if not truncated:
        for thread in [t for t in open_ if t not in seen]:
            yield thread, open_.pop(thread), "disappeared"
    for thread in [t for t, e in open_.items() if tick_ms - e.first_seen_ms > LONGEST_MS]:
        yield thread, open_.pop(thread), "too_long"
    if len(open_) > most_open:
        for _, thread in sorted((e.first_seen_ms, t) for t, e in open_.items() if t not in seen)[: len(open_) - most_open]:
            yield thread, open_.pop(thread), "evicted"


class Tracker(StatefulProcessor):
    """State of an instance: ticks that may still get rows, and the open run of each thread. A tick is worked off when the watermark
    has passed it, so neither the split into batches nor the order of arrival within the watermark's delay shows in the result."""

    def __init__(self, open_rows: bool, most_open: int):
        self.open_rows, self.most_open = open_rows, most_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "tick_ms bigint", PENDING)
        self.open = handle.getMapState("open", "thread_id bigint", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        for tick, group in frame.groupby("tick_ms"):
            old = self.pending.getValue((int(tick),)) if self.pending.containsKey((int(tick),)) else (False, [], [], [], [])
            marks = group[group["thread_id"].isna()]
            seen = group[group["thread_id"].notna()]
            lists = [[*was, *now] for was, now in zip(old[1:], (seen["thread_id"].astype("int64").tolist(), seen["time_secs"].astype("int64").tolist(), [None if d is None or d != d else d for d in seen["digest"]], seen["who"].tolist()))]
            self.pending.updateValue((int(tick),), (bool(old[0]) or bool(marks["truncated"].any()), *lists))
        due = min(t[0] for t in self.pending.keys())
        timers = list(self.handle.listTimers())
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ticks = sorted((t[0], v) for t, v in self.pending.iterator())
        open_ = {t[0]: Entry(*v) for t, v in self.open.iterator()}
        before = {t: e.values() for t, e in open_.items()}
        out = []
        for tick, (truncated, threads, secs, digests, who) in ticks:
            if tick > now:
                break
            seen: dict[int, tuple] = {}
            for thread, *x in sorted(zip(threads, secs, digests, who), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or "", x[3])):
                seen[thread] = tuple(x)  # of one thread twice in a tick the longest
            out += [(thread, *e.values(), reason) for thread, e, reason in advance(open_, tick, truncated, seen, self.most_open)]
            self.pending.removeKey((tick,))
        for thread in before.keys() - open_.keys():
            self.open.removeKey((thread,))
        changed = {t: e for t, e in open_.items() if before.get(t) != e.values()}
        for thread, e in changed.items():
            self.open.updateValue((thread,), e.values())
        left = [t for t, _ in ticks if t > now]
        if left:
            self.handle.registerTimer(left[0])
        if self.open_rows:
            out += [(thread, *e.values(), None) for thread, e in changed.items()]
        if out:
            rows = [(key[0], thread, started, secs * 1000, digest, n, last, reason, "in_flight" if reason is None else "finalized") for thread, _, started, secs, digest, _, n, last, reason in out]
            yield pd.DataFrame(rows, columns=list(RUN))

    def close(self) -> None:
        pass


def track_stream(observations: DataFrame, ticks: DataFrame, delay: str = "10 seconds", open_rows: bool = False, most_open: int = MOST_OPEN) -> DataFrame:
    """The runs of ``tracking.track_executions`` of two streams with its columns, each when it has ended.

    Rows may come in any order and batches within ``delay`` of event time; later ones are dropped by the watermark. Every tick needs
    its row in ``ticks``, also one that shows no thread. With ``open_rows`` open runs that have changed come as in_flight rows, too.
    Beyond that of the batch form: with more than ``most_open`` open runs those that a cut list lacks end as evicted, oldest first.
    State lives in RocksDB (spark.sql.streaming.stateStore.providerClass) and survives a restart from the checkpoint.
    """
    who = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("db_user", "db_host") if c in observations.columns]))
    at = F.timestamp_millis("tick_ms").alias("at")
    seen = observations.select("instance_id", "tick_ms", "thread_id", F.col("time_secs").cast("bigint").alias("time_secs"), "digest", who.alias("who"), F.lit(None).cast("boolean").alias("truncated"), at)
    none = lambda kind: F.lit(None).cast(kind)
    marks = ticks.select("instance_id", "tick_ms", none("bigint").alias("thread_id"), none("bigint").alias("time_secs"), none("string").alias("digest"), none("string").alias("who"), "truncated", at)
    rows = seen.unionByName(marks).withWatermark("at", delay)
    return rows.groupBy("instance_id").transformWithStateInPandas(Tracker(open_rows, most_open), OUT, "append", "EventTime")
