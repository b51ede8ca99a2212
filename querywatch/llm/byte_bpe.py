"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation runs no regex. Every code point gets a class (letters, numbers, white space and so on,
with one look ahead by shifted arrays), every class is a transition function on eight states, and these
functions are closed under composition: a small monoid whose product is a lookup table. Prefix products
(an associative scan in blocks) give the state before each code point, and a table of (state, class) tells
where a pre-token starts. Arrow numbers the distinct slices between starts; those that a worker's cache does
not hold are merged together, one merge in each slice per round. The slices' offsets are kept: decoding
checks that the ids of each slice give just the bytes between its offsets.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from querywatch.llm._work import cached, lean, sliced

# Classes. A1, A2: an apostrophe that opens a contraction with one or two letters, if it starts a pre-token.
# SP, WL: a blank or other white space right before a visible character. WS: other white space. END: between texts.
L, N, O, A1, A2, SP, WL, WS, END = range(9)
# States: nothing open; in letters, numbers, others; one or two letters of a contraction to come; a blank
# that the next character joins; in white space.
FREE, IN_L, IN_N, IN_O, C1, C2, BLANK, IN_WS = range(8)
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
GROUP = 1 << 20  # bytes of text scanned at once
CACHE = 150_000  # slices in each generation of a worker's cache
LONG = 64  # bytes from which on a slice is merged on its own, by a heap
NONE = np.int32(2**31 - 1)


@functools.cache
def classes() -> np.ndarray:
    table = np.full(0x110001, O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = L
        elif kind == "N":
            table[c] = N
    table[list(WHITE)] = WS
    table[0x110000] = END
    return table


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts[state, class]; then the monoid: element of each class, product table, action on states."""
    to, starts = np.zeros((9, 8), np.uint8), np.ones((8, 9), bool)
    for s in range(8):
        to[:, s] = (IN_L, IN_N, IN_O, C1, C2, BLANK, FREE, IN_WS, FREE)
        if s in (C1, C2):  # the look-ahead has seen the letters
            to[L, s], starts[s, L] = (FREE, False) if s == C1 else (C1, False)
        elif s in (IN_O, BLANK):
            to[[A1, A2], s] = IN_O
            starts[s, [O, A1, A2]] = False
        if s == BLANK:
            starts[s, [L, N]] = False
    starts[IN_L, L] = starts[IN_N, N] = starts[IN_WS, WS] = False
    elements, number, k = [tuple(range(8))], {tuple(range(8)): 0}, 0
    gens = [tuple(map(int, f)) for f in to]
    while k < len(elements):
        for g in gens:
            f = tuple(g[s] for s in elements[k])
            if f not in number:
                number[f] = len(elements)
                elements.append(f)
        k += 1
    act = np.array(elements, np.uint8)
    product = np.array([[number[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint16)
    return starts, np.array([number[g] for g in gens], np.uint16), product, act


def states_before(f: np.ndarray, product: np.ndarray, act: np.ndarray, block: int = 256) -> np.ndarray:
    """State before each position when element f[i] acts at position i and the first state is FREE."""
    n = len(f)
    if n <= block:
        out, s = np.empty(n, np.uint8), FREE
        for i, x in enumerate(f.tolist()):
            out[i], s = s, act[x, s]
        return out
    rows = -(-n // block)
    m = np.zeros(rows * block, np.uint16)
    m[:n] = f
    m = np.ascontiguousarray(m.reshape(rows, block).T)
    k, flat = product.shape[1], product.ravel()
    total = m[0].astype(np.int64)
    for row in m[1:]:
        total = flat.take(total * k + row).astype(np.int64)
    s = states_before(total.astype(np.uint16), product, act, block).astype(np.int64)
    out, flat = np.empty((block, rows), np.uint8), act.ravel()
    for j, row in enumerate(m):
        out[j] = s
        s = flat.take(row.astype(np.int64) * 8 + s).astype(np.int64)
    return np.ascontiguousarray(out.T).ravel()[:n]


def starts_of(codes: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts; 0x110000 between texts is a pre-token of its own."""
    starts, element, product, act = automaton()
    cls = classes()[codes]
    after = np.concatenate([cls[1:], [END]]).astype(np.uint8)
    visible = (after != WS) & (after != END)
    white = cls == WS
    cls[white & visible] = WL
    cls[white & visible & (codes == 0x20)] = SP
    at = np.flatnonzero(codes == 0x27)
    if len(at):
        padded = np.concatenate([codes, [0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        is_ = lambda a, x: a == ord(x)
        cls[at[is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")]] = A1
        cls[at[(is_(two, "e") & (is_(one, "r") | is_(one, "v"))) | (is_(one, "l") & is_(two, "l"))]] = A2
    return np.flatnonzero(starts[states_before(element[cls], product, act), cls])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a slice: the pair of lowest rank is merged first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or end[mid] != stop:
            continue
        alive[mid], end[i], nxt[i] = False, stop, nxt[mid]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for a, b in ((prev[i], i), (i, nxt[i])):
            if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[a], end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return tuple(out)


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """The ranks as arrays: of single bytes, of the token that two adjacent tokens form (a hash table), and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        self.pieces = pa.array(pieces, pa.binary())
        found = [(a, b, r) for piece, r in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None]
        a, b, r = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(4 * len(r)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        key, left = a << 32 | b, np.arange(len(r))
        slot = self.home(key)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = key[first], r[first]
            left = np.setdiff1d(left, first)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b form, or NONE."""
        key = a.astype(np.int64) << 32 | b
        slot = self.home(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.values[slot], NONE)
        left = np.flatnonzero((seen != key) & (seen >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            same = seen == key[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (seen >= 0)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32 bit) of each slice. A round merges the leftmost pair of lowest rank in every slice that has one."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        own = np.repeat(np.arange(len(pieces)), size)
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank, inner = np.full(len(token), NONE), np.flatnonzero(own[1:] == own[:-1])
        rank[inner] = self.together(token[inner], token[inner + 1])
        size, over = size[size > 0], []
        while len(token):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            ended = least == NONE
            if ended.any():
                out = np.repeat(ended, size)
                over.append((token[out], own[out]))
                token, own, rank, size, least = token[~out], own[~out], rank[~out], size[~ended], least[~ended]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]
            token[hit] = rank[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            token, own, rank, size = token[keep], own[keep], rank[keep], size - 1
            hit -= np.arange(len(hit))  # every slice has lost one token
            rank[hit] = NONE
            at = hit[hit + 1 < len(own)]
            at = at[own[at] == own[at + 1]]
            rank[at] = self.together(token[at], token[at + 1])
            at = hit[hit > 0] - 1
            at = at[own[at] == own[at + 1]]
            rank[at] = self.together(token[at], token[at + 1])
        if not over:
            return [b""] * len(pieces)
        token, own = (np.concatenate(x) for x in zip(*over))
        data = token[np.argsort(own, kind="stable")].astype("<i4").tobytes()
        ends = np.cumsum(4 * np.bincount(own, minlength=len(pieces)))
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]


class Merged:
    """Slice to its ids, merged when first asked for. Two generations of CACHE slices: what was used since the last turn stays."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.young: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct slices, as 32-bit bytes."""
        if len(self.young) > CACHE:
            self.older, self.young = self.young, {}
        young, older, ranks = self.young, self.older, self.vocabulary.ranks
        short = []
        for p in pieces:
            if p not in young:
                if (ids := older.get(p)) is not None:
                    young[p] = ids
                elif (rank := ranks.get(p)) is not None:
                    young[p] = rank.to_bytes(4, "little")
                elif len(p) < LONG:
                    short.append(p)
                else:
                    young[p] = np.array(merge(p, ranks), "<i4").tobytes()
        young.update(zip(short, self.vocabulary.merge_all(short), strict=True))
        return [young[p] for p in pieces]


@functools.cache
def merged(path: str) -> Merged:
    """One cache per Python worker: it outlives the tasks that the worker runs."""
    return Merged(Vocabulary(load_ranks(path)))


cached("byte_bpe", lambda: (merged.cache_clear(), load_ranks.cache_clear()))


@dataclass(frozen=True)
class Encoded:
    """Of a group of texts: the ids, how many each slice has, the slices of each text and their first bytes (and code points) in it."""

    ids: np.ndarray
    ids_of_slice: np.ndarray
    slices_of_text: np.ndarray
    first_byte: np.ndarray
    first_code: np.ndarray
    bytes_of_text: np.ndarray

    def ids_of_text(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.ids_of_slice)])[np.concatenate([[0], np.cumsum(self.slices_of_text)])])


def encode_texts(texts: pa.Array, cache: Merged) -> Encoded:
    """Texts without nulls. Every distinct slice is looked up once; Arrow and numpy deal the ids out."""
    parts = pa.concat_arrays([texts, pa.array([""], texts.type)])  # a separator behind the last text, too
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), "\0")[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    codes = np.frombuffer(str(joined, "utf-8").encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 1) - 1
    codes[ends] = 0x110000
    at = starts_of(codes)
    lead = np.flatnonzero((data & 0xC0) != 0x80) if len(codes) < len(data) else np.arange(len(data))
    bounds = np.concatenate([lead[at], [len(data)]]).astype(np.int32)
    slices = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), joined]).dictionary_encode()
    found = cache.of(slices.dictionary.to_pylist())
    known = np.frombuffer(b"".join(found), "<i4")
    long = np.fromiter(map(len, found), np.int64, len(found)) // 4
    number = slices.indices.to_numpy()
    n = long[number]
    last = np.searchsorted(at, ends)  # the separators' own slices
    n[last] = 0
    upto = np.cumsum(n)
    ids = known[np.repeat((np.cumsum(long) - long)[number] - (upto - n), n) + np.arange(upto[-1])]
    own = np.ones(len(at), bool)
    own[last] = False
    first = np.concatenate([[0], last[:-1] + 1])
    begin = np.concatenate([[0], ends[:-1] + 1])
    from_text = lambda x, start: (x - np.repeat(start, last - first + 1))[own].astype(np.int32)
    return Encoded(ids, n[own], last - first, from_text(bounds[:-1], lead[begin]), from_text(at, begin), lead[ends] - lead[begin])


def groups_of(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about GROUP bytes; a longer text is a group of its own or ends one."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GROUP)) + 1
        yield texts.slice(start, stop - start)
        start = stop


def as_lists(n: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(values, pa.int32()))


def bytes_of(ids: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """The bytes of n[0], n[1] ... ids each, and where each id begins in all of them."""
    got = vocabulary.pieces.take(pa.array(ids)) if len(ids) else pa.array([], pa.binary())
    at = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    ends = np.ascontiguousarray(at[np.concatenate([[0], np.cumsum(n)])])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), got.buffers()[2] or pa.py_buffer(b"")]), at


def decode_group(group: Encoded, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each text; fails if a slice's ids do not give just what lies between its offsets."""
    texts, at = bytes_of(group.ids, group.ids_of_text(), vocabulary)
    want = group.first_byte + np.repeat(np.cumsum(group.bytes_of_text) - group.bytes_of_text, group.slices_of_text)
    if (at[np.cumsum(group.ids_of_slice) - group.ids_of_slice] != want).any() or at[-1] != group.bytes_of_text.sum():
        raise ValueError("ids do not decode to the bytes between their slice's offsets")
    return texts


def _over_texts(docs: DataFrame, text: str, keep: tuple[str, ...], results: list[tuple[str, str]], columns: Callable[[Encoded, Merged], list[pa.Array]], path: str) -> DataFrame:
    keep = tuple(c for c in keep if c not in [name for name, _ in results])
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), *(f"`{n}` {t}" for n, t in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = merged(path)
        for batch in sliced(batches, 2000):
            done = 0
            for group in groups_of(pc.fill_null(batch.column(batch.num_columns - 1), "")):
                found = columns(encode_texts(group, cache), cache)
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(group)) for c in batch.columns[:-1]), *found], names=[*batch.schema.names[:-1], *(n for n, _ in results)])
                done += len(group)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(lean(run, "byte_bpe"), schema)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """The columns ``keep`` with ids array<int> and, if asked for, slice_starts array<int> (code points).

    Null text gives no ids, as empty text does. A text of any length is one row and one group. One row per
    input row, repeated rows alike; an empty table gives no rows. A kept column with the name of a result is
    left out.
    """
    results = [("ids", "array<int>"), ("slice_starts", "array<int>")][: 1 + offsets]
    make = lambda e, _: [as_lists(e.ids_of_text(), e.ids), as_lists(e.slices_of_text, e.first_code)][: 1 + offsets]
    return _over_texts(docs, text, keep, results, make, path)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ids array<int> and decoded binary: encoded and decoded in one pass, slice by slice by their offsets.

    Nulls, empty and long texts, repeats, empty tables and clashing names as in ``encode``.
    """
    make = lambda e, cache: [as_lists(e.ids_of_text(), e.ids), decode_group(e, cache.vocabulary)]
    return _over_texts(docs, text, keep, [("ids", "array<int>"), ("decoded", "binary")], make, path)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with decoded binary: the bytes of the ids in order. Null ids give no bytes; a kept column ``decoded`` is left out."""
    keep = tuple(c for c in keep if c != "decoded")
    kept = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = merged(path).vocabulary
        for batch in sliced(batches):
            lists = batch.column(batch.num_columns - 1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            out, _ = bytes_of(lists.flatten().to_numpy(), n, vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "decoded"])

    return df.select(*keep, df[ids].alias("__ids")).mapInArrow(lean(run, "byte_bpe"), schema)
