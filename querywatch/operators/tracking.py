"""Executions from process-list snapshots as gaps and islands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

#: Fixed value: a run is closed at the first tick beyond this time after its first sighting, in ms.
LONGEST_MS = 3_600_000

RUN = ("instance_id", "thread_id", "started_at_ms", "duration_ms", "app_digest", "sightings", "last_seen_ms", "end_reason", "state")

#: Ticks of an instance travel in rows of an hour; threads of an instance with more sightings than this go to several places.
TICKS_MS, PLACE = 3_600_000, 1 << 17
#: Instances that may have several places, the largest; any other has at most this part of all sightings.
SPLIT = 1000


def _changes(column: pa.Array) -> np.ndarray:
    """Which rows differ from the row before; the first does. Nulls are equal."""
    there = np.asarray(column.is_valid())
    differ = np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), False))
    return np.concatenate([[True], differ | (there[1:] != there[:-1])])


def _ranks(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, null is -1, and the values."""
    coded = column.dictionary_encode()
    order = np.asarray(pc.array_sort_indices(coded.dictionary))
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    return rank[np.asarray(pc.fill_null(coded.indices, len(order)))], coded.dictionary.take(pa.array(order))


def _lean(rows: DataFrame) -> DataFrame:
    """Little to deal: one array of numbers (steps of the ticks, elapsed times, places of the digests among the row's own)."""
    rows = rows.withColumn("digests", F.array_distinct(F.array_compact("digest")))
    steps = F.transform("tick_ms", lambda t, i: t - F.coalesce(F.get("tick_ms", i - 1), F.lit(0)))
    named = F.transform("digest", lambda d: F.array_position("digests", d))
    rest = [c for c in rows.columns if c not in ("tick_ms", "time_secs", "digest")]
    return rows.select(*rest, F.concat(steps, "time_secs", named).alias("numbers"))


def _numbers(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the elements of ``_lean`` rows: row, tick and whether it is known, elapsed time and whether it is known, place of the digest or 0."""
    lists = rows["numbers"].combine_chunks()
    size = np.asarray(pc.list_value_length(lists))
    n, values = size // 3, lists.flatten()
    row = np.repeat(np.arange(len(n)), n)
    here = np.arange(len(row))
    begins = np.cumsum(n) - n
    at = (np.cumsum(size) - size)[row] + here - begins[row]
    there, values = np.asarray(values.is_valid()), np.asarray(pc.fill_null(values, 0))
    step, known = values[at], there[at]
    restart = np.append(False, ~known)[: len(at)]
    restart[begins[n > 0]] = True
    total = np.cumsum(step)
    tick = total - (total - step)[np.maximum.accumulate(np.where(restart, here, 0))]
    return row, tick, known, values[at + n[row]], there[at + n[row]], values[at + 2 * n[row]]


def _part(new: np.ndarray, island: np.ndarray, start: np.ndarray, tick: np.ndarray, digest: np.ndarray, cut: np.ndarray) -> None:
    """Where an island goes on behind the cut of a run, its later sightings are told apart one by one, in ``new``."""
    behind = np.flatnonzero(tick > cut[start])
    first = behind[np.unique(island[behind], return_index=True)[1]]
    ends = np.append(np.flatnonzero(island == np.arange(len(island))), len(island))
    for at, end in zip(first.tolist(), ends[np.searchsorted(ends, first, "right")].tolist()):
        until, known = -1, -1
        for i, (t, d, c) in enumerate(zip(tick[at:end].tolist(), digest[at:end].tolist(), cut[at:end].tolist()), at):
            new[i] = i == at or t > until or (d >= 0 and known >= 0 and d != known)
            if new[i]:
                until, known = c, d
            elif known < 0:
                known = d


def _runs(marks: tuple[np.ndarray, ...], rows: pa.Table, group: np.ndarray, key: np.ndarray, who: list[str]) -> Iterator[pa.Table]:
    """Runs of whole threads, which are in order of their group. marks: group, tick, whether its list is whole, in order of both."""
    of, at, whole = marks
    row, tick, there, secs, known_time, named = _numbers(rows)
    secs = np.where(known_time, secs, -(1 << 53))
    lists = rows["digests"].combine_chunks()
    size, (ranks, digests) = np.asarray(pc.list_value_length(lists)), _ranks(lists.flatten())
    digest = np.append(ranks, -1)[np.where(named > 0, (np.cumsum(size) - size)[row] + named - 1, len(ranks))]
    persons = [_ranks(rows[c].combine_chunks())[0] for c in who]
    low = min(at.min(initial=0), tick.min(initial=0))
    span = int(max(at.max(initial=0), tick.max(initial=0)) - low) + LONGEST_MS + 1
    if group[-1] > group[0] and int(group[-1] + 1) * span >= 1 << 62:  # beyond 64 bits: in two parts
        middle = (group[0] + group[-1] + 1) // 2
        for side, ticks in ((group < middle, of < middle), (group >= middle, of >= middle)):
            base = group[side][0]
            yield from _runs((of[ticks] - base, at[ticks], whole[ticks]), rows.filter(pa.array(side)), group[side] - base, key[side], who)
        return
    placed, asked = of * span + (at - low), group[row] * span + (tick - low)  # a place in time of a group
    found = np.searchsorted(placed, asked)
    order = np.flatnonzero(there & (np.append(placed, -1)[found] == asked))
    order = order[np.lexsort((tick[order], key[row[order]]))]
    again = (np.diff(tick[order]) == 0) & (np.diff(key[row[order]]) == 0)
    if again.any():  # of one thread twice in a tick the longest
        order = order[np.lexsort((*[p[row[order]] for p in reversed(persons)], digest[order], secs[order], known_time[order], tick[order], key[row[order]]))]
        order = order[~np.append((np.diff(tick[order]) == 0) & (np.diff(key[row[order]]) == 0), False)]
    row, tick, secs, known_time, digest, found, asked = row[order], tick[order], secs[order], known_time[order], digest[order], found[order], asked[order]
    if not len(order):
        return
    thread, here = key[row], np.arange(len(order))
    total = np.cumsum(whole)
    complete, complete_before = total[found], total[found] - whole[found]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(thread) != 0) | (known_time[1:] & known_time[:-1] & (np.diff(secs) < 0)) | (complete_before[1:] > complete[:-1])
    for p in persons:
        fresh[1:] |= np.diff(p[row]) != 0
    island = np.maximum.accumulate(np.where(fresh, here, 0))
    known = np.maximum.accumulate(np.where(digest >= 0, here, -1))
    before = np.append(-1, known[:-1])
    new = fresh | ((before >= island) & (digest >= 0) & (digest != digest[before]))
    behind = np.searchsorted(placed, asked + LONGEST_MS, "right")  # the first tick more than LONGEST_MS later, of that group
    has_cut = np.append(of, -1)[behind] == group[row]
    cut = np.where(has_cut, np.append(at, 0)[behind], np.iinfo(np.int64).max)
    _part(new, island, np.maximum.accumulate(np.where(new, here, 0)), tick, digest, cut)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    followed = np.append(thread[first[1:]] == thread[first[:-1]], False)
    then = np.append(first[1:], 0)
    too_long = has_cut[first] & (np.append(total, 0)[behind[first]] == complete[last]) & (~followed | (tick[then] > cut[first]))
    ends = np.searchsorted(of, group[row[first]], "right") - 1
    gone = np.where(followed, complete_before[then], total[ends]) > complete[last]
    longest = np.maximum.reduceat(secs, first)
    told = known[last] >= first
    yield pa.table({
        "instance_id": rows["instance_id"].take(pa.array(row[first])), "thread_id": rows["thread_id"].take(pa.array(row[first])), "started_at_ms": pa.array(tick[first] - secs[first] * 1000, mask=~known_time[first]),
        "duration_ms": pa.array(longest * 1000, mask=longest == -(1 << 53)), "app_digest": digests.take(pa.array(digest[known[last]], mask=~told)), "sightings": last - first + 1, "last_seen_ms": tick[last],
        "too_long": too_long, "gone": gone, "followed": followed})


def _marks(rows: pa.Table, group: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Each tick of each group once, after those held of group 0; its list is whole if no row says that it was cut."""
    row, tick, _, cut, _, _ = _numbers(rows)
    of, at, whole = np.append(np.zeros(len(held[0]), np.int64), group[row]), np.append(held[0], tick), np.append(held[1], cut == 0)
    order = np.lexsort((whole, at, of))
    of, at, whole = of[order], at[order], whole[order]
    one = np.append(True, (np.diff(of) != 0) | (np.diff(at) != 0))[: len(of)]  # a cut one comes first
    return of[one], at[one], whole[one].astype(np.int64)


def _tracked(who: list[str]):
    """Runs of a partition in which each place's ticks come first, then its threads. Held are the ticks of one instance and one thread."""

    def work(rows: pa.Table, held: tuple | None, whole: bool) -> tuple[Iterator[pa.RecordBatch], tuple | None, pa.Table]:
        mark = np.asarray(rows["mark"].combine_chunks())
        moved = _changes(rows["instance_id"].combine_chunks()) | _changes(rows["place"].combine_chunks())
        changed = moved | _changes(rows["mark"].combine_chunks()) | _changes(rows["thread_id"].combine_chunks())
        group, key = np.cumsum(moved) - 1, np.cumsum(changed) - 1
        done = len(rows) if whole else int(np.flatnonzero(changed)[-1])
        if not done:
            return iter(()), held, rows
        names = [(rows["instance_id"][i].as_py(), rows["place"][i].as_py()) for i in (0, done - 1)]
        old = held[1:] if held and held[0] == names[0] else (np.empty(0, np.int64), np.empty(0, bool))
        ticks, threads = np.flatnonzero(mark[:done]), np.flatnonzero(~mark[:done])
        of, at, good = _marks(rows.take(pa.array(ticks)), group[ticks], old)
        found = _runs((of, at, good), rows.take(pa.array(threads)), group[threads], key[threads], who) if len(threads) and len(of) else ()
        mine = of == group[done - 1]
        return (b for t in found for b in t.to_batches()), (names[1], at[mine], good[mine].astype(bool)), rows.slice(done)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(pa.Table.from_batches([batch]))
            ends = [[t[c][i].as_py() for c in ("instance_id", "place", "mark", "thread_id")] for t, i in ((rest[0], 0), (rest[-1], len(batch) - 1))]
            if len(rest) > 1 and ends[0] == ends[1]:
                continue  # one thread only
            found, held, left = work(pa.concat_tables(rest), held, False)
            yield from found
            rest = [left]
        if rest and sum(map(len, rest)):
            yield from work(pa.concat_tables(rest), held, True)[0]

    return run


def track_executions(observations: DataFrame, ticks: DataFrame) -> DataFrame:
    """Runs of each thread: a new one begins when user, host or digest changes, elapsed time falls, or a complete tick lacks the thread.

    An unknown digest (null) agrees with any, and a run has the first known one. ``ticks`` says of each tick whether its list was
    cut; an absence from a cut list ends nothing. A run ends as thread_reused, disappeared or too_long (at the first tick more than
    LONGEST_MS after its first sighting, seen there or not; the next sighting begins another run); without an end it is in_flight.
    Of one thread twice in a tick the longest counts.

    A row of ``observations`` is one sighting, or several of one thread with tick_ms, time_secs and digest as arrays (what the others
    lack is unknown): so rows are dealt once, before they are many. Threads are dealt by instance, those of the largest instances to several places,
    and each place gets its instance's ticks. A task holds these (17 bytes each) and one thread at a time.
    """
    who = [c for c in ("db_user", "db_host") if c in observations.columns]
    packed = isinstance(observations.schema["tick_ms"].dataType, ArrayType)
    kinds = {"tick_ms": "bigint", "time_secs": "bigint", "digest": "string"}
    lists = [(F.col(c).cast(f"array<{kind}>") if packed else F.array(F.col(c).cast(kind))).alias(c) for c, kind in kinds.items()]
    alike = lambda c: F.when(F.size(c) == F.size("tick_ms"), F.col(c)).otherwise(F.transform("tick_ms", lambda _, i: F.get(c, i))).alias(c)
    seen = observations.select("instance_id", "thread_id", *lists, *who).filter("instance_id is not null and tick_ms is not null")
    if packed:
        seen = seen.select("instance_id", "thread_id", "tick_ms", alike("time_secs"), alike("digest"), *who)
    marks = ticks.filter("instance_id is not null and tick_ms is not null").groupBy("instance_id", F.floor(F.col("tick_ms") / TICKS_MS).alias("hour"))
    marks = marks.agg(F.array_sort(F.collect_list(F.struct(F.col("tick_ms").cast("bigint").alias("tick_ms"), F.coalesce("truncated", F.lit(False)).cast("bigint").alias("cut")))).alias("x"))
    marks = marks.select("instance_id", F.col("x.tick_ms").alias("tick_ms"), F.col("x.cut").alias("time_secs"))

    # an instance has no more places than keep its ticks, sent to each, fewer than half of its sightings
    large = seen.groupBy("instance_id").agg(F.sum(F.size("tick_ms")).alias("n")).filter(F.col("n") > PLACE).orderBy(F.desc("n"), "instance_id").limit(SPLIT)
    large = marks.join(F.broadcast(large), "instance_id").groupBy("instance_id").agg(F.first("n").alias("n"), F.sum(F.size("tick_ms")).alias("ticks"))
    large = F.broadcast(large.select("instance_id", F.ceil(F.col("n") / F.greatest(F.col("ticks") * 2, F.lit(PLACE))).cast("int").alias("places")))
    places = F.coalesce("places", F.lit(1))
    own = seen.join(large, "instance_id", "left").withColumns({"place": F.pmod(F.xxhash64("thread_id"), places).cast("int"), "mark": F.lit(False)}).drop("places")
    # ticks as rows of the same columns: whether they were cut takes the place of elapsed times
    none = lambda c: F.lit(None).cast(seen.schema[c].dataType).alias(c)
    unnamed = F.transform("time_secs", lambda _: F.lit(None).cast("string")).alias("digest")
    all_ = marks.join(large, "instance_id", "left").select("instance_id", none("thread_id"), "tick_ms", "time_secs", unnamed, *map(none, who), F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), F.lit(True).alias("mark"))
    rows = _lean(own.unionByName(all_)).repartition("instance_id", "place").sortWithinPartitions("instance_id", "place", F.desc("mark"), "thread_id")

    kept = [StructField(c, seen.schema[c].dataType) for c in ("instance_id", "thread_id")]
    longs = [StructField(c, LongType()) for c in ("started_at_ms", "duration_ms", "sightings", "last_seen_ms")]
    flags = [StructField(c, BooleanType()) for c in ("too_long", "gone", "followed")]
    digest = StructField("app_digest", seen.schema["digest"].dataType.elementType)
    schema = StructType([*kept, *longs[:2], digest, *longs[2:], *flags])
    runs = rows.mapInArrow(_tracked(who), schema)
    reason = F.when(F.col("too_long"), "too_long").when(F.col("gone"), "disappeared").when(F.col("followed"), "thread_reused")
    return runs.withColumns({"end_reason": reason, "state": F.when(reason.isNotNull(), "finalized").otherwise("in_flight")}).select(*RUN)
