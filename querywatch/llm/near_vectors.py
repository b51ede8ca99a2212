"""Near-duplicate vectors: an exact metric range join by pivots, within each label.

Vectors of a label link when their cosine is at least ``cosine``: their unit vectors are then at most
r = sqrt(2 - 2 * cosine) apart. Equal vectors are one class from the start, so copies cost one row each.
Pivots of a large label cut it into cells of nearest pivots. A pair whose vectors have different homes
meets in the cell of smaller number, so a vector is replicated only to smaller cells, and only where the
triangle inequality leaves room: |y - p_c| - |y - p_home| <= 2r, and y is at most r from the plane between
the two pivots. Cells then join independently, large ones in tiles of bounded size.

Within r / 2 of a cell's pivot all vectors are linked by the same inequality. They are the cell's core: its
links come from sums over the cell, and no tile compares core vectors with each other. A third of all rows
around one vector costs a pass, not its square. Dense regions that are wider than that are compared in full.

Tiles give no pairs, but for each vector the number of its links there and the smallest vector of its
component in the tile; components are joined from these.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType

from querywatch.llm._work import discard, save, scratch
from querywatch.llm.jaccard_join import components

COSINE = 0.98
CELL = 2048  # classes of a label for each pivot, at least
PIVOTS = 2048  # most pivots that are planned for
PIVOT_BYTES = 16 << 20  # and the bytes that they may have
TILE = 4096  # vectors of one side of a tile
STRIPE = 512  # rows of a tile compared at once
EDGE = 1e-12  # cosines this close to the limit are summed exactly
CORE, OWN, CORE_COPY, COPY = range(4)  # own vectors of a cell and replicas, near the pivot or not


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, by a power of two brought near 1, so that squares neither overflow nor vanish."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosine_of(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two scaled vectors from correctly rounded sums."""
    dot, aa, bb = (math.fsum((x * y).tolist()) for x, y in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(aa * bb)


def _read(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) of those that can link: not null, not empty, all components finite, not all zero."""
    for i, v in enumerate(column):
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + 0  # -0 is 0
            if np.isfinite(x).all() and x.any():
                yield i, x


def _signed(batches: Iterator[pa.RecordBatch], kind: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """The first columns with dim and sig (a digest of the vector, null if it links with nothing), and its bytes if asked for."""
    for batch in batches:
        n = batch.num_rows
        dims, sigs, data = np.zeros(n, np.int32), [None] * n, [None] * n
        for i, x in _read(batch.column(n_cols := batch.num_columns - 1), kind):
            b = x.tobytes()
            dims[i], sigs[i], data[i] = len(x), hashlib.blake2b(b, digest_size=16).digest(), b
        more = [pa.array(data, pa.binary())] if whole else []
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(dims), pa.array(sigs, pa.binary()), *more], names=[*batch.schema.names[:n_cols], "dim", "sig", "v"][: n_cols + 2 + whole])


def spread(pivots: np.ndarray, least: float) -> np.ndarray:
    """The pivots in order, without those that are within ``least`` of an earlier one."""
    kept: list[int] = []
    for i, p in enumerate(pivots):
        if not kept or (pivots[kept] @ p).max() < 1 - least * least / 2:
            kept.append(i)
    return pivots[kept]


def places(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, kind): the home of each unit vector and its replicas in smaller cells."""
    d = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
    home = d.argmin(axis=1)
    mine = d[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    slack = 1e-7  # far above the rounding of a distance
    near = (d - mine <= 2 * r + slack) & (d * d - mine * mine <= 2 * (r + slack) * apart + slack)
    near &= np.arange(len(pivots)) <= home[:, None]
    row, cell = np.nonzero(near)
    core, own = d[row, cell] <= r / 2 - slack, cell == home[row]
    return row, cell, np.where(own, np.where(core, CORE, OWN), np.where(core, CORE_COPY, COPY))


def _assign(batches: Iterator[pa.RecordBatch], large: dict, kind: str, r: float) -> Iterator[pa.RecordBatch]:
    """Columns label, dim, bin, cid, m, v: a row for each cell that a class has a place in; small labels share a tile by their bin."""
    for batch in batches:
        labels, dims = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        by: dict[tuple, list[int]] = {}
        for i, at in enumerate(zip(labels, dims.tolist(), strict=True)):
            by.setdefault(at if at in large else None, []).append(i)
        for at, rows in by.items():
            part = batch.take(pa.array(rows))
            group = part.column(2).to_numpy()
            row, cell, how = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), OWN)
            if at is not None:
                x = units(np.stack([np.frombuffer(v, kind) for v in part.column(5).to_pylist()]))
                row, cell, how = places(x, large[at][1], r)
                group = np.full(len(row), large[at][0])
            part = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int64()), pa.array(cell, pa.int32()), pa.array(how, pa.int32()), part.column(0), *part.columns[3:]],
                names=["bin", "cell", "kind", "label", "cid", "m", "v"])


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, when the pairs a, b join components as well."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(la, lb), np.minimum(la, lb))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def compare(x: np.ndarray, kind: np.ndarray, block: np.ndarray, m: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of the vectors of a tile: rows linked with each, and the smallest place of its component.

    Left out are pairs of replicas, pairs that are certain, and pairs within a block if the tile has two.
    """
    raw, x = scaled(x), units(x)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    near, copied, two = (kind == CORE) | (kind == CORE_COPY), kind >= CORE_COPY, block.min() != block.max()
    for at in range(0, len(x), STRIPE):
        i, j = np.arange(at, min(at + STRIPE, len(x))), np.arange(at, len(x))
        c = x[i] @ x[j].T
        may = (c >= least - EDGE) & (j > i[:, None]) & ~(copied[i][:, None] & copied[j]) & ~(near[i][:, None] & near[j])
        if two:
            may &= block[i][:, None] != block[j]
        a, b = np.nonzero(may)
        keep = c[a, b] >= least + EDGE
        for k in np.flatnonzero(~keep).tolist():
            keep[k] = cosine_of(raw[i[a[k]]], raw[j[b[k]]]) >= least
        a, b = i[a[keep]], j[b[keep]]
        if len(a):
            links += np.bincount(a, m[b], len(x)).astype(np.int64) + np.bincount(b, m[a], len(x)).astype(np.int64)
            label = joined(label, a, b)
    return links, label


def _tile(table: pa.Table, kind: str, least: float) -> pa.Table:
    """cid, links, mate of the vectors that have links in this tile; small labels are compared one after the other."""
    v = table.column("v").to_pylist()
    how, block, cid, m = (table.column(c).to_numpy() for c in ("kind", "block", "cid", "m"))
    of: dict[tuple, list[int]] = {}
    for i, (label, data) in enumerate(zip(table.column("label").to_pylist(), v, strict=True)):
        of.setdefault((label, len(data)), []).append(i)
    out = []
    for rows in of.values():
        at = np.array(rows)[np.argsort(cid[rows], kind="stable")]
        if len(at) > 1:
            links, label = compare(np.stack([np.frombuffer(v[i], kind) for i in at.tolist()]), how[at], block[at], m[at], least)
            hit = links > 0
            out.append((cid[at][hit], links[hit], cid[at][label[hit]]))
    cids, links, mates = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"cid": pa.array(cids, pa.int64()), "links": pa.array(links, pa.int64()), "mate": pa.array(mates, pa.int64())})


def _pivots(classes: DataFrame, kind: str, r: float) -> tuple[dict, int]:
    """{(label, dim): (number, pivots)} of the labels with more classes than a cell, and the classes of all.

    At most 2 * PIVOTS pivots of PIVOT_BYTES reach the driver: with more classes, cells grow.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total, widest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, min(PIVOTS, PIVOT_BYTES // (16 * widest)))
    cell = max(CELL, total // most)
    large = sizes.filter(F.col("n") > cell)
    share = F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("double") / 2.0**32  # sig is a digest: uniform
    drawn = classes.join(large, ["label", "dim"]).filter(share * F.col("n") < F.ceil(F.col("n") / cell) + 1).select("label", "dim", "sig", "v")
    found: dict[tuple, list] = {}
    for row in sorted(drawn.toLocalIterator(), key=lambda x: bytes(x["sig"])):
        found.setdefault((row["label"], row["dim"]), []).append(np.frombuffer(row["v"], kind))
    return {at: (i, spread(units(np.stack(v)), r)) for i, (at, v) in enumerate(found.items())}, total


def classes(df: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included), kept.

    Rows with a null label link with nothing, and so do vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of different lengths; such a row is its own component and stays. Equal
    vectors of a label are linked; of repeated rows each counts as one, and all rows with the id of their
    component stay. Rows with a null vec_id take part, but name a component only if no other has an id; then its
    rows stay. An empty table gives no rows, other columns are ignored. Vectors of any length are read whole.
    """
    if not isinstance(df.schema[vec_id].dataType, IntegralType):
        raise TypeError(f"{vec_id} must be an integer column")
    element = df.schema[vector].dataType
    if not isinstance(element, ArrayType) or not isinstance(element.elementType, (FloatType, DoubleType)):
        raise TypeError(f"{vector} must be an array of float or double")
    spark, at = df.sparkSession, scratch(df.sparkSession)
    kind = "<f4" if isinstance(element.elementType, FloatType) else "<f8"
    r = math.sqrt(2 - 2 * cosine)
    of_label = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.when(F.col(label).isNotNull(), F.col(vector)).alias("x"))
    head = f"vec_id bigint, label {of_label}, dim int, sig binary"
    signed = rows.mapInArrow(lambda batches: _signed(batches, kind, False), head)
    held = rows.mapInArrow(lambda batches: _signed(batches, kind, True), f"{head}, v binary").filter("sig IS NOT NULL")
    distinct = held.groupBy("label", "dim", "sig").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    distinct = save(distinct.withColumn("cid", F.monotonically_increasing_id()), f"{at}/classes")
    large, total = _pivots(distinct, kind, r)

    bins = max(1, -(-total // TILE))
    small = -1 - F.pmod(F.xxhash64("label", "dim"), F.lit(bins))
    given = distinct.select("label", "dim", small.alias("bin"), "cid", "m", "v")
    placed = given.mapInArrow(lambda batches: _assign(batches, large, kind, r), f"bin bigint, cell int, kind int, label {of_label}, cid bigint, m bigint, v binary")
    placed = save(placed, f"{at}/placed")
    several = F.col("bin") >= 0
    of = lambda *kinds: F.col("kind").isin(*kinds)
    count = lambda *kinds: F.ceil(F.count_if(of(*kinds)) / TILE).cast("int")
    cells = placed.filter(several).groupBy("bin", "cell").agg(
        count(CORE).alias("n_core"), count(OWN).alias("n_own"), count(CORE_COPY, COPY).alias("n_copy"), F.count(F.lit(1)).alias("n"), F.count_if(of(OWN, COPY)).alias("wide"),
        F.coalesce(F.sum(F.when(of(CORE), F.col("m"))), F.lit(0)).alias("m_core"), F.coalesce(F.sum(F.when(of(CORE_COPY), F.col("m"))), F.lit(0)).alias("m_copy"), F.min(F.when(of(CORE), F.col("cid"))).alias("first"))
    in_cells = placed.filter(several).join(save(cells, f"{at}/cells"), ["bin", "cell"])

    # blocks of a cell: core, own, replicas; tiles (lo, hi) of those that have pairs to compare
    group = F.when(of(CORE), 0).when(of(OWN), 1).otherwise(2)
    first = F.when(group == 0, 0).when(group == 1, F.col("n_core")).otherwise(F.col("n_core") + F.col("n_own"))
    blocks = F.when(group == 0, F.col("n_core")).when(group == 1, F.col("n_own")).otherwise(F.col("n_copy"))
    own_block = (first + F.pmod(F.xxhash64("cid"), F.greatest(blocks, F.lit(1)))).cast("int")
    own_from, copy_from, end = F.col("n_core"), F.col("n_core") + F.col("n_own"), F.col("n_core") + F.col("n_own") + F.col("n_copy")
    which = lambda b: F.when(b < own_from, 0).when(b < copy_from, 1).otherwise(2)
    others = F.filter(F.sequence(F.lit(0), end - 1), lambda b: ~((which(b) == group) & (group != 1)))
    whole = F.col("n") <= TILE
    tiled = in_cells.filter("wide > 0").withColumn("block", F.when(whole, 0).otherwise(own_block)).withColumn("other", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(others)))
    tiled = tiled.select("bin", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "kind", "label", "cid", "m", "v")
    alone = placed.filter(~several).select("bin", "cell", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), "kind", "label", "cid", "m", "v")
    met = alone.unionByName(tiled).groupBy("bin", "cell", "lo", "hi").applyInArrow(lambda table: _tile(table, kind, cosine), "cid bigint, links bigint, mate bigint")

    # all of a core are linked with each other and with the replicas as near
    sure = in_cells.filter(of(CORE, CORE_COPY) & F.col("first").isNotNull()).select("cid", (F.col("m_core") + F.when(of(CORE), F.col("m_copy") - F.col("m")).otherwise(0)).alias("links"), F.col("first").alias("mate"))
    met = save(met.unionByName(sure), f"{at}/met")
    discard(spark, f"{at}/placed", f"{at}/cells")
    label_of = components(met.filter("cid <> mate").select(F.col("cid").alias("a"), F.col("mate").alias("b")), f"{at}/stars").select(F.col("node").alias("cid"), F.col("label").alias("root"))
    linked = distinct.select("label", "dim", "sig", "m", "low", "cid").join(met.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(label_of, "cid", "left")
    linked = linked.select("label", "dim", "sig", "low", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = save(linked.join(lowest, "root").select("label", "dim", "sig", "n_links", "component_id"), f"{at}/named")
    out = signed.join(named, ["label", "dim", "sig"], "left")
    one = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), one.alias("component_id"), F.coalesce(F.col("vec_id") == one, one.isNull()).alias("kept"))
