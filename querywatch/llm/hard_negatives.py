"""Hard negatives by segment summaries.

Each vector is stored with the mean and the deviation of its segments, few wide ones and more narrow ones.
In a segment of l components two vectors' inner product is l times the product of their means, plus or minus
l times the product of their deviations; summed over segments this bounds their score from both sides. A
block of rows is first held against a block of anchors by the wide segments. Rows that no anchor can use go,
those left are held against them by the narrow ones, and what still may count is scored exactly.

Anchors are a set of queries against all rows, in tiles of bounded size: rows and anchors are dealt to
blocks by hash, each tile gives only what may be among an anchor's best, and windows merge the tiles. What
is shuffled grows with rows times anchor blocks plus anchors times row blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegralType, NumericType

from querywatch.llm._work import discard, partitions, save, scratch

LEVELS = (4, 16)  # segments of a vector
ROWS = 1 << 16  # rows of a tile
ANCHORS = 1 << 13  # anchors of a tile
LEAST = 2048  # rows that are worth a tile of their own
STRIPE, CHUNK = 64, 4096  # anchors and rows that are compared at once
EXACT = 2.0**53  # doubles hold all integers up to here
NEVER = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Choice:
    """``positives`` rows of an anchor's label, and for each ``negatives`` rows of others whose score lies in low % to high % of its score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def edges(dim: int, level: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(level, dim) + 1).astype(np.int64))


def summaries(x: np.ndarray) -> np.ndarray:
    """For each level the means and the deviations of the segments, both times the root of their length."""
    out = []
    for level in LEVELS:
        cut = edges(x.shape[1], level)
        n = np.diff(cut)
        mean = np.add.reduceat(x, cut[:-1], axis=1) / n
        rest = x - np.repeat(mean, n, axis=1)
        out += [mean * np.sqrt(n), np.sqrt(np.add.reduceat(rest * rest, cut[:-1], axis=1))]
    return np.concatenate(out, axis=1)


def bounds(a: np.ndarray, b: np.ndarray, dim: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores of the vectors whose summaries are a with those of b."""
    at = 0
    for k in LEVELS[:level]:
        at += 2 * (len(edges(dim, k)) - 1)
    n = len(edges(dim, LEVELS[level])) - 1
    mean, apart = a[:, at : at + n] @ b[:, at : at + n].T, a[:, at + n : at + 2 * n] @ b[:, at + n : at + 2 * n].T
    slack = 1e-9 * (np.abs(mean) + apart) + 0.25  # scores are integers
    return mean - apart - slack, mean + apart + slack


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors held in doubles; beyond 64 bits they stay at the largest or least number there is."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    largest = lambda x: float(np.sqrt((x * x).sum(axis=1)).max())
    with np.errstate(over="ignore"):
        if largest(a) * largest(b) < EXACT:
            return np.rint(a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    clip = lambda v: max(NEVER + 1, min(v, -NEVER - 1))
    return np.array([[clip(sum(map(int.__mul__, x, y))) for y in whole[1]] for x in whole[0]], np.int64)


def _described(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """vec_id, label, anchor with dim, v (the scaled components' floors) and s (the summaries); rows that take no part are left out."""
    for batch in batches:
        of: dict[int, list[int]] = {}
        x = {}
        for i, v in enumerate(batch.column(3)):
            if v.is_valid and len(v.values) and v.values.null_count == 0:
                row = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(row).all():
                    x[i] = np.clip(np.floor(row * scale), -1e300, 1e300)
                    of.setdefault(len(row), []).append(i)
        for dim, rows in of.items():
            part, own = batch.take(pa.array(rows)), np.stack([x[i] for i in rows])
            with np.errstate(over="ignore", invalid="ignore"):
                s = summaries(own)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(np.full(len(rows), dim, np.int32)), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in s], pa.binary())],
                names=["vec_id", "label", "anchor", "dim", "v", "s"])


@dataclass
class Side:
    """Vectors of one length and their summaries."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    s: np.ndarray

    def take(self, at: np.ndarray) -> Side:
        return Side(self.row[at], self.vec_id[at], self.label[at], self.x[at], self.s[at])


def _side(t: pa.Table, codes: np.ndarray, at: np.ndarray) -> Side:
    t = t.take(pa.array(at))
    stack = lambda c: np.stack([np.frombuffer(v, np.float64) for v in t.column(c).to_pylist()]) if len(at) else np.zeros((0, 1))
    return Side(t.column("row").to_numpy(), t.column("vec_id").to_numpy(), codes[at], stack("v"), stack("s"))


def best(anchors: Side, rows: Side, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): for each query the k rows of highest score, ties by vec_id and row, within its limits.

    Query q is for anchor q // limits, limits being the columns of low and high; rows are of the anchor's
    label (``same``) or of others, and never the anchor itself.
    """
    n_limits = low.shape[1]
    order = np.lexsort((rows.row, rows.vec_id))  # equal scores then stand in the order that decides
    rows = rows.take(order)
    usable = float(np.abs(anchors.x).max(initial=0)) * float(np.abs(rows.x).max(initial=0)) < 1e15
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(anchors.row), STRIPE):
        own = np.arange(start, min(start + STRIPE, len(anchors.row)))
        a = anchors.take(own)
        lo, hi = low[own], high[own]
        kth = np.full((len(own), n_limits), NEVER)  # of the best so far
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for at in range(0, len(rows.row), CHUNK):
            cols = np.arange(at, min(at + CHUNK, len(rows.row)))
            may = (a.label[:, None] == rows.label[cols]) == same
            may &= a.row[:, None] != rows.row[cols]
            for level in range(len(LEVELS)) if usable else ():
                cols, may = _alive(cols, may)
                if not len(cols):
                    break
                least, most = bounds(a.s, rows.s[cols], rows.x.shape[1], level)
                able = np.zeros_like(may)
                for j in range(n_limits):
                    floor = np.maximum(lo[:, j], kth[:, j]).astype(np.float64)[:, None]
                    fits = may & (most >= floor) & (least <= hi[:, j].astype(np.float64)[:, None])
                    if fits.shape[1] > k:  # k rows that are sure to count leave out all that are sure to score less
                        sure = np.where(fits & (most <= hi[:, j][:, None]) & (least >= lo[:, j][:, None]), least, -np.inf)
                        fits &= most >= np.partition(sure, -k, axis=1)[:, -k][:, None]
                    able |= fits
                may = able
            cols, may = _alive(cols, may)
            if not len(cols):
                continue
            got = scores(a.x, rows.x[cols])
            for j in range(n_limits):
                fit = np.where(may & (got >= np.maximum(lo[:, j], kth[:, j])[:, None]) & (got <= hi[:, j][:, None]), got, NEVER)
                if fit.shape[1] > k:
                    fit[fit < np.partition(fit, -k, axis=1)[:, -k][:, None]] = NEVER
                q, c = np.nonzero(fit != NEVER)
                held = tuple(np.concatenate(x) for x in zip(held, (q * n_limits + j, cols[c], fit[q, c])))
            held = _first(held, k)
            full = np.bincount(held[0], minlength=len(own) * n_limits) >= k
            last = np.full(len(own) * n_limits, np.iinfo(np.int64).max)
            np.minimum.at(last, held[0], held[2])
            kth = np.where(full, last, NEVER).reshape(-1, n_limits)
        out.append((held[0] + start * n_limits, held[1], held[2]))
    q, c, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return q, order[c], score


def _alive(cols: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = may.any(axis=0)
    return cols[some], may[:, some]


def _first(held: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of each query the first k, by score and then by place."""
    order = np.lexsort((held[1], -held[2], held[0]))
    q, c, s = (x[order] for x in held)
    new = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    nth = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    return q[nth < k], c[nth < k], s[nth < k]


def _in_tile(t: pa.Table, find: Callable[[pa.Table, Side, Side, np.ndarray], list[pa.Table]]) -> list[pa.Table]:
    """``find`` for the vectors of each length of a tile."""
    t = t.combine_chunks()
    codes = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy() if t.num_rows else np.zeros(0, np.int32)
    dims, query = t.column("dim").to_numpy(), t.column("query").to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(dims):
        asked, there = np.flatnonzero((dims == dim) & query), np.flatnonzero((dims == dim) & ~query)
        if len(asked) and len(there):
            asked = asked[np.argsort(codes[asked], kind="stable")]
            out += find(t, _side(t, codes, asked), _side(t, codes, there), asked)
    return out


def _whole(out: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(out) if out else schema.empty_table()


NEAR = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
FOUND = pa.schema([("row", pa.int64()), ("nth", pa.int32()), ("other", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _positives(t: pa.Table, k: int) -> pa.Table:
    def find(_: pa.Table, anchors: Side, rows: Side, __: np.ndarray) -> list[pa.Table]:
        out = []
        for label in np.unique(anchors.label):
            a, b = anchors.take(np.flatnonzero(anchors.label == label)), rows.take(np.flatnonzero(rows.label == label))
            free = np.full((len(a.row), 1), NEVER + 1)
            q, c, score = best(a, b, True, free, -free, k)
            out.append(pa.table([a.row[q], b.row[c], b.vec_id[c], score], schema=NEAR))
        return out

    return _whole(_in_tile(t, find), NEAR)


def limits(score: int, choice: Choice) -> tuple[int, int]:
    """Least and largest integer score of a negative for this positive's score."""
    return -(-choice.low * score // 100), choice.high * score // 100


def _negatives(t: pa.Table, choice: Choice) -> pa.Table:
    def find(t: pa.Table, anchors: Side, rows: Side, at: np.ndarray) -> list[pa.Table]:
        lists = t.column("positives").take(pa.array(at)).to_pylist()
        low, high = np.full((len(at), choice.positives), 1), np.zeros((len(at), choice.positives), np.int64)  # no score fits
        for i, scores_ in enumerate(lists):
            for j, s in enumerate(scores_ or ()):
                low[i, j], high[i, j] = limits(s, choice)
        q, c, score = best(anchors, rows, False, low, high, choice.negatives)
        return [pa.table([anchors.row[q // choice.positives], (q % choice.positives).astype(np.int32), rows.row[c], rows.vec_id[c], score], schema=FOUND)]

    return _whole(_in_tile(t, find), FOUND)


def mine(df: DataFrame, anchor: Column, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", scale: float = 1.0, choice: Choice = Choice()) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components count as floor(scale * x); a score is the integer inner product, at most 64 bits wide. An anchor's
    positives are the ``choice.positives`` other rows of its label with the highest scores, or all; each one's
    negatives are the first ``choice.negatives`` rows of other labels, or all, whose score is from low % to
    high % of the positive's. Ties go to the smaller vec_id. Rows with a null vec_id or label, or a vector that is
    null, empty or holds null or non-finite components, take no part; rows whose vectors differ in length are
    not compared. Repeated rows are rows of their own: one may be the other's positive, and an anchor
    that stands there twice gives its result twice. An empty table or one without anchors gives no rows; other
    columns are ignored.
    """
    if not isinstance(df.schema[vec_id].dataType, IntegralType):
        raise TypeError(f"{vec_id} must be an integer column")
    element = df.schema[vector].dataType
    if not isinstance(element, ArrayType) or not isinstance(element.elementType, NumericType):
        raise TypeError(f"{vector} must be an array of numbers")
    spark, at = df.sparkSession, scratch(df.sparkSession)
    of_label = df.schema[label].dataType.simpleString()
    given = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("x"))
    given = given.filter("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(lambda batches: _described(batches, scale), f"vec_id bigint, label {of_label}, anchor boolean, dim int, v binary, s binary")
    base = save(given.withColumn("row", F.monotonically_increasing_id()), f"{at}/base")
    n, asked = base.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    n_rows = max(1, -(-n // ROWS), min(partitions(spark), n // LEAST))
    n_anchors = max(1, -(-asked // ANCHORS))

    # Tiles (rows, anchors): each row is in a tile with every block of anchors and the other way round.
    by = F.xxhash64("row")
    dealt = lambda own, others, name, other: [F.pmod(by, F.lit(own)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)]
    columns = ["row", "vec_id", "label", "dim", "v", "s"]
    there = base.select(*columns, *dealt(n_rows, n_anchors, "rows", "anchors")).withColumns({"query": F.lit(False), "positives": F.lit(None).cast("array<bigint>")})
    queries = lambda anchors: anchors.select(*columns, "positives", *dealt(n_anchors, n_rows, "anchors", "rows")).withColumn("query", F.lit(True))
    tiles = lambda anchors: there.unionByName(queries(anchors)).groupBy("rows", "anchors")
    best_first = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "other")
    anchors = base.filter("anchor")
    near = tiles(anchors.withColumn("positives", F.lit(None).cast("array<bigint>"))).applyInArrow(lambda t: _positives(t, choice.positives), "row bigint, other bigint, positive_id bigint, score bigint")
    near = near.withColumn("nth", F.row_number().over(best_first) - 1).filter(F.col("nth") < choice.positives)
    near = save(near.select("row", "nth", "positive_id", F.col("score").alias("positive_score")), f"{at}/positives")
    listed = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("of")).select("row", F.col("of.positive_score").alias("positives"))
    found = tiles(anchors.join(listed, "row")).applyInArrow(lambda t: _negatives(t, choice), "row bigint, nth int, other bigint, negative_id bigint, negative_score bigint")
    best_first = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id", "other")
    found = save(found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= choice.negatives), f"{at}/found")
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    out = save(found.join(named, ["row", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), f"{at}/out")
    discard(spark, *(f"{at}/{x}" for x in ("base", "positives", "found")))
    return out
