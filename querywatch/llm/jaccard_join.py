"""Exact near-duplicate classes: Jaccard join of five-word shingle sets at 0.75 by universe partitioning.

Two sets with 100 * |A n B| >= 75 * |A u B| differ in at most H = floor((|A| + |B|) / 7) shingles. For each
band of sizes the shingle universe is hashed into segments. A segment compared as a whole (its subset of the
set is hashed to one key) misses only pairs that differ there, so it takes one difference to hide a pair; a
segment that also indexes its one-deletion neighbourhood takes two. Where a set's segments are worth H + 1
together, every partner shares a key with it. How many segments of either kind a band has is the cheapest
choice that covers nearly all sets (``allocation``).

Exactness does not rest on "nearly": empty segments are worth nothing to a set, and sets whose others are
not worth H + 1 meet each other on their empty segments, too. A set whose segments are worth ``slack`` more
than H + 1 shares more than ``slack`` keys with any partner, so by the prefix principle it leaves its
``slack`` most popular keys out, in one order for all sets; passages that many sets share fall away like this.
Members of a key that are not yet in one component are held against parity sketches, an exact bound.

Candidates are verified on their whole shingle sets. Shingles are 64-bit hashes; equal sets have equal
128-bit signatures and are one class from the start, so copies cost one row each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from querywatch.llm._work import cached, discard, lean, partitions, save, scratch, sliced

WIDTH = 5
GROWTH = 1.8  # of the sizes from band to band; 1.7 to 2 gives the fewest keys
BANDS = 40
ROUNDS = 3
SMALL = 6  # bands below leave no popular keys out
SLACK = 0.06  # share of the segments beyond H + 1, for popular keys to be left out
BLOCK = 8192  # members of a key that are compared at once
CROWD = 16  # members of a key from which on pairs are held against large sketches
EDGES = 1 << 18  # pairs of a tile that are held before all but a forest of them go
NEAREST = 4  # rounds of closest pairs at most
MARKS = 8  # keys of a set that decide where a pair is kept
FLUSH = 1 << 19  # keys gathered before they are dealt to buckets
GROUP = 1 << 19  # bytes of text hashed at once
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# --- shingle sets -------------------------------------------------------------------------------------------

STEP = 0xD1342543DE82EF95
BYTE = mix(np.arange(256, dtype=U), 7)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, STEP, U), np.full(n, pow(STEP, -1, 2**64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_usual = functools.cache(lambda: _powers(2 * GROUP))
cached("jaccard_join", lambda: _usual.cache_clear())


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse; only the usual length is kept in memory."""
    return _usual() if n <= 2 * GROUP else _powers(n)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``width`` words are one shingle, no words none."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * down[: len(data)], dtype=U)])
    words = mix((total[end] - total[start]) * up[end - 1] + (end - start).astype(U))
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, edge + 1)
    long = np.zeros(max(0, len(words) - width + 1), U)
    for j in range(width):
        long += mix(words[j : len(words) - width + 1 + j], j)
    long = mix(long, 50)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            h = np.sort(long[a : b - width + 1])
            keep = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        elif b > a:
            h = np.full(1, b - a, U)
            for j in range(b - a):
                h += mix(words[a + j : a + j + 1], 100 + j)
            out.append(mix(h, 60))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    two = (s ^ (s >> U(29))) * U(0xE7037ED1A0B428DB)
    return int(s.sum(dtype=U).view(np.int64)), int((two ^ (two >> U(32))).sum(dtype=U).view(np.int64)) ^ len(s)


# --- bands and allocation -----------------------------------------------------------------------------------


@functools.cache
def edge(k: int) -> int:
    """Smallest size of band k: pairs are met in the band of their smaller set."""
    return 1 if k == 0 else max(edge(k - 1) + 1, int(edge(k - 1) * GROWTH))


@functools.cache
def bands(n: int) -> tuple[int, ...]:
    """The band of size n, and bands below whose sets can have partners of size n."""
    k = 0
    while edge(k + 1) <= n:
        k += 1
    return (k, *(j for j in range(max(0, k - 2), k) if 3 * n <= 4 * (edge(j + 1) - 1)))


def most_differences(n: int, k: int) -> int:
    """H over all partners that a set of n shingles can have in band k."""
    return (n + 4 * n // 3) // 7 if n < edge(k + 1) else (n + edge(k + 1) - 1) // 7


@functools.cache
def allocation(k: int) -> tuple[int, int]:
    """(whole, deleting): segments of each kind in band k that index the fewest keys and cover nearly all sets.

    The costs alone decide on deletions: they pay for sets of 3 to 8 shingles, whole segments are cheaper for others.
    """
    top = 4 * (edge(k + 1) - 1) // 3
    sizes = sorted({edge(k), edge(k + 1) - 1, min(edge(k + 1), top), top, (edge(k) + top) // 2})
    h = max(most_differences(s, k) for s in sizes)
    best = None
    for x in range(7):
        for y in range(max(0, h + 1 - 2 * x), 3 * h + 12, 1 + h // 200):
            m = x + y
            if m == 0:
                continue
            ok, cost = True, 0.0
            for s in sizes:
                p0 = (1 - 1 / m) ** s
                p1 = s / m * (1 - 1 / m) ** (s - 1)
                mean = y * (1 - p0) + x * (2 - 2 * p0 - p1)
                sd = (y * p0 * (1 - p0) + x * (p0 + p1) * (2 - p0 - p1)) ** 0.5
                ok &= mean - (1.5 if k < SMALL else 2) * sd >= most_differences(s, k) + 1 + SLACK * m * (k >= SMALL)
                cost += y * (1 - p0) + x * (1 - p0) + x * s / m
            if ok:
                if best is None or cost < best[0]:
                    best = (cost, y, x)
                break
    return best[1:]


def keys_of(s: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Keys of a set in band k, and its slack: what its segments are worth beyond H + 1."""
    y, x = allocation(k)
    m = x + y
    seg = ((s >> U(32)) * U(m)) >> U(32)  # s is sorted, and so are the segments
    seg, h = seg.astype(np.int64), (s ^ (s >> U(31))) * U(0x9FB21C651E98DF25)
    begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    size = np.diff(np.concatenate([begin, [len(s)]]))
    at, sums = seg[begin], np.add.reduceat(h, begin)
    base = mix(np.arange(m, dtype=U), 3000 + k)
    keys = [mix(sums + base[at], 1)]
    worth = len(at)
    if x:
        deep = at >= y
        worth += int((size[deep] > 1).sum())
        two = np.repeat(deep & (size > 1), size)
        keys.append(mix((np.repeat(sums, size) - h)[two] + base[seg[two]], 1))
    slack = worth - most_differences(len(s), k) - 1
    if slack < 0:
        void = np.ones(m, bool)
        void[at] = False
        if x:
            void[at[deep & (size == 1)]] = True
        keys.append(mix(base[void], 1))
    return (keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys))), slack


# --- the index ----------------------------------------------------------------------------------------------

MEMBER = np.dtype([("low", "<u4"), ("high", "u1")])  # 40 bits of the key; the bucket holds more, and what still collides is verified
CLASS = np.dtype([("c1", "<i8"), ("c2", "<u2"), ("band", "u1"), ("keys", "u1")])  # 80 bits of the signature tell the classes of an index apart; so many members follow
RUN = 255  # members that one reference to a class stands for
PIECES = 4  # of a bucket, by the last bits of the keys: what is unpacked at once
DOC = "row_id bigint, doc_id bigint, n bigint, c1 bigint, c2 bigint, bands array<int>, slacks array<int>"
ROWS = f"kind int, {DOC}, key bigint, band int, met int"


def text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in sliced(batches):
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append((t or "").encode())
            size += len(texts[-1])
            if size >= GROUP:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def references(cls: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The classes that ``own`` (in order) names, each with the number of members that it stands for, RUN at most."""
    used, n = np.unique(own, return_counts=True)
    times = -(-n // RUN)
    out = cls[np.repeat(used, times)]
    nth = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    out["keys"] = np.minimum(np.repeat(n, times) - RUN * nth, RUN)
    return out


def _index(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, docs, members): the keys of many sets, packed by bucket with the signatures they refer to."""
    names = ["bucket", "info", "classes", "members"]
    rnd = 0

    def flush(info: dict, classes: list, keys: list) -> pa.RecordBatch:
        nonlocal rnd
        rnd += 1
        rows = [[rnd % buckets], [info], [b""], [b""]]
        if keys:
            key = np.concatenate([k for k, _ in keys])
            own = np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys])
            cls = np.empty(len(keys), CLASS)
            cls["c1"], c2 = np.array(classes, np.int64).T
            cls["c2"], cls["band"] = c2 & 0xFFFF, [b for _, b in keys]
            to = (mix(key) % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                at = order[ends[b] : ends[b + 1]]
                out = np.empty(len(at), MEMBER)
                out["low"], out["high"] = key[at] & U(2**32 - 1), key[at] >> U(56)
                for column, v in zip(rows, (b, None, references(cls, own[at]).tobytes(), out.tobytes()), strict=True):
                    column.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], INFO), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=names
        )

    info, classes, keys, size, seen = [], [], [], 0, set()
    for ids, texts in text_groups(batches):
        for i, s in zip(ids, shingle_sets(texts), strict=True):
            sig, own = signature(s), bands(len(s)) if len(s) else ()
            got = [keys_of(s, k) for k in own]
            info.append({**i, "n": len(s), "c1": sig[0], "c2": sig[1], "bands": list(own), "slacks": [x for _, x in got]})
            if sig in seen:  # equal sets of this task are indexed once
                continue
            seen.add(sig)
            for k, (found, _) in zip(own, got, strict=True):
                keys.append((found, k))
                classes.append(sig)
                size += len(found)
        if size >= FLUSH or len(info) >= 20_000 or len(keys) >= 60_000:
            yield flush(info, classes, keys)
            info, classes, keys, size, seen = [], [], [], 0, set()
    if info:
        yield flush(info, classes, keys)


INFO = pa.list_(pa.struct([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bands", pa.list_(pa.int32())), ("slacks", pa.list_(pa.int32()))]))
OUT = pa.schema([("kind", pa.int32()), *((f.name, f.type) for f in INFO.value_type), ("key", pa.int64()), ("band", pa.int32()), ("met", pa.int32())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a row per document; kind 1: a row per set and key that other sets have too, met = their number (c2: its last 16 bits).

    Rows come in the order of their buckets; one bucket is in memory at a time, packed.
    """
    held, at = [], None
    for batch in batches:
        for info in batch.column(1):
            if info.is_valid and len(info.values):
                rows = info.values
                n = len(rows)
                void = lambda t: pa.nulls(n, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(rows.field(i) for i in range(7)), void(pa.int64()), void(pa.int32()), void(pa.int32())], schema=OUT)
        for bucket, classes, members in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if bucket != at:
                yield from _unpacked(held, at)
                held, at = [], bucket
            held.append((classes.as_py(), members.as_py()))
    yield from _unpacked(held, at)


def _unpacked(held: list[tuple[bytes, bytes]], bucket: int | None) -> Iterator[pa.RecordBatch]:
    """What meets in a bucket, piece by piece; equal keys are in one piece."""
    for piece in range(PIECES):
        rows = []
        for classes, members in held:
            m, cls = np.frombuffer(members, MEMBER), np.frombuffer(classes, CLASS)
            own = np.flatnonzero(m["low"] % PIECES == piece)
            m, cls = m[own], cls[np.repeat(np.arange(len(cls)), cls["keys"])[own]]
            rows.append((m["low"].astype(U) | m["high"].astype(U) << U(32) | U(bucket) << U(40), cls["band"], cls["c1"], cls["c2"].astype(np.int64)))
        yield from _met(rows)


def _met(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    key, band, c1, c2 = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    more = ~new | np.concatenate([~new[1:], [False]]) if len(k) else new
    at = order[more]
    key, band, c1, c2 = key[at], band[at], c1[at], c2[at]
    order = np.lexsort((c2, c1, key))
    key, band, c1, c2 = key[order], band[order], c1[order], c2[order]
    if not len(key):
        return
    new = np.concatenate([[True], key[1:] != key[:-1]])
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
    key, band, c1, c2, new = key[fresh], band[fresh], c1[fresh], c2[fresh], new[fresh]
    run = np.cumsum(new) - 1
    met = np.bincount(run)[run]
    for a in range(0, len(key), 100_000):
        part = slice(a, a + 100_000)
        keep = met[part] > 1
        n = int(keep.sum())
        if n:
            void = lambda t: pa.nulls(n, t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), void(pa.int64()), void(pa.int64()), void(pa.int64()), pa.array(c1[part][keep]), pa.array(c2[part][keep]), void(pa.list_(pa.int32())), void(pa.list_(pa.int32())),
                 pa.array(key[part][keep].view(np.int64)), pa.array(band[part][keep].astype(np.int32)), pa.array(met[part][keep].astype(np.int32))], schema=OUT)


# --- links --------------------------------------------------------------------------------------------------


def components(edges: DataFrame, at: str, limit: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without edges are left out.

    Alternating large and small stars; each round halves the depth, and stops when nothing changes.
    """
    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{at}-0")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before = state(e)
    for i in range(1, limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = save(small.filter("u <> v").distinct(), f"{at}-{i}")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _alike(a: Column, b: Column) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * 75)


def sketch_bits(k: int) -> int:
    """Bits of the large sketch: 8 or more for each shingle, up to 2048 of them."""
    return min(16384, max(64, 1 << (8 * edge(k + 1) - 1).bit_length()))


def parity_sketch(s: np.ndarray, k: int) -> bytes:
    """For each of the band's bits, whether an odd number of shingles hashes to it.

    A shingle that only one of two sets has flips one bit, so the bits in which their sketches differ are at
    most their differences; a pair with 7 times as many such bits than shingles in both together cannot link.
    """
    m = sketch_bits(k)
    return np.packbits((np.bincount((mix(s, 9) & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, k: int) -> bytes:
    """The sketch of fewer bits, about one or two for each shingle: enough to tell most sets of band k apart."""
    small = min(len(sketch), max(8, 1 << (edge(k + 1) // 8).bit_length()))
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, small)).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = []
        for cid, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = s.values.to_numpy().view(U)
            for k in bands(len(s)):
                whole = parity_sketch(s, k)
                out.append((cid, k, whole, folded(whole, k)))
        cids, ks, whole, small = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(ks, pa.int32()), pa.array(whole, pa.binary()), pa.array(small, pa.binary())], names=["cid", "band", "whole", "small"])


def _tiles(still: DataFrame, drawn: DataFrame, links: DataFrame) -> DataFrame:
    """Members of each key with their sketches and marks, their block and the pair (lo, hi) of blocks to be compared, in order.

    A key with more than BLOCK members has many such pairs, on as many tasks; from CROWD members on the large
    sketches are there, too. Marks are a set's MARKS smallest keys in the band; never are the sets of smaller id that
    were found not to link with it.
    """
    marks = still.groupBy("cid", "band").agg(F.slice(F.array_sort(F.collect_list("key")), 1, MARKS).alias("marks"))
    never = links.filter(~F.col("linked")).groupBy(F.col("b").alias("cid")).agg(F.collect_list("a").alias("never"))
    rows = still.join(drawn.join(marks, ["cid", "band"]).join(never, "cid", "left"), ["cid", "band"]).withColumn("whole", F.when(F.col("members") >= CROWD, F.col("whole")))
    blocks = F.ceil(F.col("members") / BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return rows.select("key", "band", "lo", "hi", "block", "cid", "label", "n", "home", "marks", "small", "whole", "never")


def forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which edges are a lightest spanning forest over the groups of the nodes: fewer edges than groups."""
    own = np.unique(group, return_inverse=True)[1]
    order, taken = np.lexsort((v, u, weight)), []
    while len(order := order[own[u[order]] != own[v[order]]]):
        # the lightest edge of each tree joins it with another one; ties have one order, so these close no ring
        a, b = own[u[order]], own[v[order]]
        trees, first = np.unique(np.stack([a, b], axis=1).ravel(), return_index=True)
        first //= 2
        taken.append(order[np.unique(first)])
        to = np.arange(own.max() + 1)
        to[trees] = np.where(a[first] == trees, b[first], a[first])
        back = (to[to[trees]] == trees) & (trees < to[trees])  # two trees that chose one edge: the smaller one stays
        to[trees[back]] = trees[back]
        while (further := to[to]).tolist() != to.tolist():
            to = further
        own = to[own]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], closest: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a key, are in different components and may link by their sketches.

    With ``closest`` just a spanning forest of them over the components that meet in a tile, of the pairs whose sketches
    differ least: fewer pairs than members, however many may link. Else a pair is kept at the smallest key that both
    have among their marks, and at every key only if there is none: it comes about once, however many keys it shares.
    Pairs that were found not to link are left out. Rows come in the order of ``_tiles``, one tile is in memory at a time.
    """
    first, second, found = [], [], 0
    last = np.iinfo(np.int64).max

    def gathered() -> pa.RecordBatch:
        a, b = np.concatenate(first), np.concatenate(second)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    for tiles in _whole_tiles(batches):
        key, band, lo, hi, block, cid, label, n, home = (tiles.column(i).to_numpy(zero_copy_only=False) for i in range(9))
        own = tiles.column(9)
        sizes = pc.list_value_length(own).to_numpy()
        marks = np.full((len(key), MARKS), last)
        marks[np.arange(MARKS) < sizes[:, None]] = own.flatten().to_numpy()
        apart_from = tiles.column(12)  # sets with smaller ids that do not link with this one
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
        for start, end in zip(new[:-1].tolist(), new[1:].tolist()):
            within = lo[start] == hi[start]
            order = start + np.argsort(cid[start:end])
            left = order if within else order[block[order] == lo[start]]
            right = left if within else order[block[order] == hi[start]]
            small, whole = (np.frombuffer(b"".join(tiles.column(c).slice(start, end - start).to_pylist()), U).reshape(end - start, -1) if tiles.column(c)[start].is_valid else None for c in (10, 11))
            never = apart_from.slice(start, end - start)
            counts = pc.fill_null(pc.list_value_length(never), 0).to_numpy(zero_copy_only=False)
            never = np.rec.fromarrays([never.flatten().to_numpy(), np.repeat(cid[start:end], counts)])
            never.sort()
            edges, held = [], 0

            def lightest(edges: list) -> list:
                u, v, weight = (np.concatenate(x) for x in zip(*edges))
                kept = forest(u - start, v - start, weight, label[start:end])  # noqa: B023
                return [(u[kept], v[kept], weight[kept])]

            for at, i in enumerate(left.tolist()):
                j = right[at + 1 :] if within else right
                j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= 75 * np.maximum(n[j], n[i])) & np.where(n[j] < n[i], home[j], home[i])]
                for bits in (small, whole):
                    if bits is not None and len(j):
                        apart = np.bitwise_count(bits[j - start] ^ bits[i - start]).sum(axis=1, dtype=np.int64)
                        may = 7 * apart <= n[j] + n[i]
                        j, apart = j[may], apart[may]
                if len(never) and len(j):
                    asked = np.rec.fromarrays([np.minimum(cid[j], cid[i]), np.maximum(cid[j], cid[i])])
                    at_most = np.minimum(np.searchsorted(never, asked), len(never) - 1)
                    j, apart = j[never[at_most] != asked], apart[never[at_most] != asked]
                if not len(j):
                    continue
                if closest:
                    edges.append((np.full(len(j), i), j, apart / (n[j] + n[i])))
                    held += len(j)
                    if held > EDGES:
                        edges = lightest(edges)
                        held = len(edges[0][0])
                    continue
                common = np.where((marks[j][:, :, None] == marks[i]).any(2), marks[j], last).min(1)
                j = j[(common == key[i]) | (common == last)]
                if len(j):
                    first.append(np.full(len(j), cid[i]))
                    second.append(cid[j])
                    found += len(j)
            if edges:
                u, v, _ = lightest(edges)[0]
                first.append(cid[u])
                second.append(cid[v])
                found += len(u)
            if found > 1 << 18:
                yield gathered()
                first, second, found = [], [], 0
    if found:
        yield gathered()


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that no tile lies in two batches."""
    kept = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        if kept and any(kept[-1].column(i)[kept[-1].num_rows - 1] != batch.column(i)[0] for i in range(4)):
            yield pa.concat_batches(kept)
            kept = []
        if len(change):
            yield pa.concat_batches([*kept, batch.slice(0, int(change[-1]))])
            kept, batch = [], batch.slice(int(change[-1]))
        kept.append(batch)
    if kept:
        yield pa.concat_batches(kept)


def _joined(labels: DataFrame, links: DataFrame, at: str) -> DataFrame:
    """cid, label after the links: only the components that they join are a graph, however many links join two of them."""
    of = lambda c: labels.select(F.col("cid").alias(c), F.col("label").alias(f"of_{c}"))
    edges = links.filter("linked").join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b").distinct()
    names = components(edges, f"{at}-stars").select(F.col("node").alias("label"), F.col("label").alias("name"))
    return save(labels.join(names, "label", "left").select("cid", F.coalesce("name", "label").alias("label")), at)


def _still_apart(live: DataFrame, labels: DataFrame, drawn: DataFrame, links: DataFrame, parts: int, step: str, at: str) -> DataFrame:
    """a, b: the pairs of a step that are in different components and may link."""
    key, tile = Window.partitionBy("key", "band"), ("key", "band", "lo", "hi")
    groups = live.join(labels, "cid").withColumns({"hi": F.max("label").over(key), "lo": F.min("label").over(key), "members": F.count(F.lit(1)).over(key)})
    groups = groups.filter((F.col("lo") != F.col("hi")) & (F.col("members") >= (2 if step == "all" else CROWD)))
    still = save(groups.select("key", "band", "cid", "label", "n", "home", "members"), f"{at}/open-{step}")
    tiles = _tiles(still, drawn, links).repartition(parts, *tile).sortWithinPartitions(*tile)
    return save(tiles.mapInArrow(lean(functools.partial(_pairs, closest=step != "all")), "a bigint, b bigint").distinct(), f"{at}/rest-{step}")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked for the distinct pairs; only the sets that they name are dealt."""
    sets = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi")
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared * 100 >= (F.size("sa") + F.size("sb") - shared) * 75).alias("linked"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null and empty texts have no shingles and link with nothing; component_id is then the row's own doc_id.
    Rows with a null doc_id take part; they never name a component that has another id. Repeated rows share
    a component. A text of any length is one set. An empty table gives no rows; other columns are ignored.
    ``docs`` is read twice and must give the same rows in the same partitions, as a stored table does.
    """
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be an integer column")
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    parts = partitions(spark)
    buckets = parts  # the fewer there are, the fewer references to a class
    source = docs.select(F.struct(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("bigint").alias("doc_id")).alias("row"), F.col(text).alias("text"))
    packed = source.mapInArrow(lean(lambda batches: _index(batches, buckets), "jaccard_join"), f"bucket int, info array<struct<{DOC.replace(' ', ':').replace(',:', ',')}>>, classes binary, members binary")
    rows = packed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(_meet), ROWS)
    rows = save(rows, f"{at}/met")
    discard(spark)
    all_docs = save(rows.filter("kind = 0").select("row_id", "doc_id", "n", "c1", "c2", "bands", "slacks"), f"{at}/docs")
    sets_of = all_docs.filter("n > 0").groupBy("c1", "c2").agg(F.min("row_id").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("slacks").alias("slacks"))
    met = rows.filter("kind = 1").select("c1", F.col("c2").alias("tail"), "key", "band", "met")
    members = met.join(sets_of.withColumn("tail", F.col("c2").bitwiseAND(F.lit(0xFFFF))), ["c1", "tail"])
    slack = F.element_at("slacks", F.array_position("bands", F.col("band")).cast("int"))
    members = members.select("c1", "tail", "cid", "n", "key", "band", "met", slack.alias("slack"), (F.element_at("bands", 1) == F.col("band")).alias("home"))
    deep = [k for k in range(BANDS) if allocation(k)[1]]
    spare = (F.col("slack") >= 0) & ~F.col("band").isin(deep)
    widest = Window.partitionBy("c1", "tail", "cid", "band").orderBy(F.desc("met"), F.desc("key"))  # dealt as for the join
    live = members.withColumns({"spare": F.when(spare, F.col("slack")).otherwise(0), "rank": F.row_number().over(widest)})
    live = save(live.filter("rank > spare").select("key", "band", "cid", "n", "home"), f"{at}/live")
    discard(spark, f"{at}/met")
    asked = sets_of.select("cid", "c1", "c2").join(live.select("cid").distinct(), "cid", "left_semi")
    sets = save(_sets(source, asked), f"{at}/sets")
    discard(spark)

    # Likely links first: each set against the first set of another component on one of its keys, the one it
    # meets there most often. A few such rounds, linear in the keys, join most components.
    links, labels = None, save(live.select("cid").distinct().withColumn("label", F.col("cid")), f"{at}/labels")
    for i in range(ROUNDS):
        # dealt by key once, before what the window compares is put together; a group that is large spills
        marked = live.join(labels, "cid").repartition("key") if i else live.repartition("key").withColumn("label", F.col("cid"))
        key = Window.partitionBy("key")
        joined = marked.withColumns({"hub": F.min(F.struct("label", "cid", "n")).over(key), "hi": F.max("label").over(key)}).filter("hub.label <> hi")
        if i:  # a key whose members are all in one component has nothing more to say: only the others go on
            joined = save(joined.select("key", "band", "cid", "n", "home", "label", "hub"), f"{at}/live-{i}")
            discard(spark, f"{at}/live" if i == 1 else f"{at}/live-{i - 1}")
            live = joined.select("key", "band", "cid", "n", "home")
        met = joined.filter((F.col("label") != F.col("hub.label")) & _alike(F.col("n"), F.col("hub.n"))).groupBy("cid", F.col("hub.cid").alias("other")).agg(F.count(F.lit(1)).alias("shared"))
        if links is not None:
            done = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
            met = met.join(done, (F.least("cid", "other") == F.col("x")) & (F.greatest("cid", "other") == F.col("y")), "left_anti")
        near = met.groupBy("cid").agg(F.max_by("other", F.struct("shared", -F.col("other"))).alias("other"))
        near = save(near.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct(), f"{at}/near-{i}")
        found = save(_verify(near, sets), f"{at}/links-{i}")
        links = found if links is None else links.unionByName(found)
        labels = _joined(labels, found, f"{at}/joined-{i}")
        discard(spark)

    # Then pairs of a key that are still in different components and that their sketches let pass: of crowded keys the
    # closest ones, as long as these join components, and all that are left.
    drawn = save(sets.select("cid", "shingles").mapInArrow(lean(_sketches), "cid bigint, band int, whole binary, small binary"), f"{at}/drawn")
    steps = [f"closest-{i}" for i in range(NEAREST)]
    while True:
        step = steps.pop(0) if steps else "all"
        rest = _still_apart(live, labels, drawn, links, parts, step, at)
        discard(spark)  # the tiles' shuffle goes before whole sets are dealt
        found = save(_verify(rest, sets), f"{at}/links-{step}")
        links = links.unionByName(found)
        labels = _joined(labels, found, f"{at}/joined-{step}")
        discard(spark, *(f"{at}/{x}-{step}" for x in ("open", "rest")))
        if step == "all":
            break
        if not found.filter("linked").head(1):
            steps = []
    named = all_docs.join(sets_of.select("c1", "c2", "cid"), ["c1", "c2"], "left").join(labels, "cid", "left")
    named = named.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "cid")).otherwise(F.col("row_id")).alias("label"))
    named = save(named, f"{at}/named")
    discard(spark, *(f"{at}/{x}" for x in ("docs", f"live-{ROUNDS - 1}", "sets", "drawn", *(f"{x}-{i}" for x in ("near", "links") for i in (*range(ROUNDS), *(f"closest-{i}" for i in range(NEAREST)), "all")))))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _sets(source: DataFrame, asked: DataFrame) -> DataFrame:
    """cid, shingles: the whole set of each asked class, from the text of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_groups(batches):
            found = shingle_sets(texts)
            if any(signature(s) != (row["c1"], row["c2"]) for row, s in zip(rows, found, strict=True)):
                raise ValueError("the documents did not come in the same order twice")
            yield pa.RecordBatch.from_arrays([pa.array([r["cid"] for r in rows], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["cid", "shingles"])

    texts = source.withColumn("cid", F.col("row.row_id")).join(asked, "cid").select(F.struct("cid", "c1", "c2").alias("row"), "text")
    return texts.mapInArrow(lean(run, "jaccard_join"), "cid bigint, shingles array<bigint>")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each component the row of smallest doc_id (nulls last, then the first row), with all its columns.

    Texts without words are components of their own and stay. doc_id may be of any type that can be ordered; see
    ``classes`` for the rest.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    of = classes(rows, text, "__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__of"))
    order = F.struct(F.col(doc_id).isNull().alias("void"), F.col(doc_id).alias("id"), "__row")
    first = rows.select("__row", order.alias("__at")).join(of, "__row").groupBy("__of").agg(F.min("__at")["__row"].alias("__row"))
    return rows.join(first.select("__row"), "__row", "left_semi").drop("__row")
