"""Closest pairs of a key: a spanning forest of what may link, however many pairs that are."""

import numpy as np
import pyarrow as pa

from querywatch.llm import jaccard_join

U = np.uint64


def tile(sets, labels, never=None):
    """All sets in one tile of their band, as ``_tiles`` gives them."""
    k, n = jaccard_join.bands(len(sets[0]))[0], len(sets)
    sketches = [jaccard_join.parity_sketch(s, k) for s in sets]
    longs = lambda v: pa.array(v, pa.int64())
    columns = [longs([7] * n), pa.array([k] * n, pa.int32()), longs([0] * n), longs([0] * n), longs([0] * n), longs(range(n)), longs(labels), longs([len(s) for s in sets]), pa.array([True] * n),
               pa.array([[7]] * n, pa.list_(pa.int64())), pa.array([jaccard_join.folded(x, k) for x in sketches], pa.binary()), pa.array(sketches, pa.binary()), pa.array(never or [None] * n, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "band", "lo", "hi", "block", "cid", "label", "n", "home", "marks", "small", "whole", "never"])


def pairs(batch, **how):
    return [(a, b) for out in jaccard_join._pairs(iter([batch]), **how) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]


def near_copies(n):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 150).astype(U)
    return [np.unique(np.concatenate([base[:-4], r.integers(0, 2**63, 4).astype(U)])) for _ in range(n)]


def test_near_copies_give_fewer_pairs_than_members(monkeypatch):
    batch = tile(near_copies(60), range(60))
    for most in (1 << 18, 50):  # held at once
        monkeypatch.setattr(jaccard_join, "EDGES", most)
        got = pairs(batch, closest=True)
        joined = list(range(60))
        for a, b in got:
            joined = [joined[a] if x == joined[b] else x for x in joined]
        assert len(got) == 59 and len(set(joined)) == 1
    assert len(pairs(batch)) == 60 * 59 // 2


def test_pairs_known_not_to_link_are_not_asked_again():
    sets = near_copies(4)
    never = [None, [0], [0, 1], None]
    assert sorted(pairs(tile(sets, range(4), never))) == [(0, 3), (1, 3), (2, 3)]
    assert sorted(pairs(tile(sets, range(4), never), closest=True)) == [(0, 3), (1, 3), (2, 3)]
    assert pairs(tile(sets, range(4), [None, [0], [0, 1], [0, 1, 2]]), closest=True) == []


def test_forest_is_the_lightest():
    r = np.random.default_rng(8)
    for n in (2, 5, 30):
        u, v = np.triu_indices(n, 1)
        weight, group = r.integers(0, 4, len(u)) / 4, r.integers(0, max(1, n // 2), n)
        own, total = group.tolist(), 0.0
        for e in np.argsort(weight, kind="stable").tolist():
            a, b = own[u[e]], own[v[e]]
            if a != b:
                own, total = [a if x == b else x for x in own], total + weight[e]
        kept = jaccard_join.forest(u, v, weight, group)
        assert weight[kept].sum() == total and len(kept) == len(set(group.tolist())) - 1
