"""Alignment of two tokenizers' tokens: byte-level BPE (A) and sentence pieces (B).

Both encode the whole text. Where both have a token end at the same byte and the next one starts with a
blank, the text is cut: such anchors need no search, and what lies between two of them is a window that
depends on its token ids alone. Windows recur (most are a word), so a window is aligned once in a worker and
kept by its two id tuples. Arrow numbers the distinct windows of a group of texts, numpy deals their
alignments out: groups of tokens between shared ends, and links, the pairs of tokens that have bytes in common.

A corpus-wide count of an id pair is its number of links. Documents keep their links as packed numbers in a
table, each task's sums are added up to the counts, and a join brings those back to the documents. The counts
are broadcast only while they are few; with more, the join shuffles.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from querywatch.llm import byte_bpe
from querywatch.llm._work import discard, save, scratch, sliced

FEW = 1 << 19  # counted pairs that may be broadcast: 24 bytes each, some 30 MB with the hash table
MEMO = 200_000  # windows that a worker keeps in each generation
TIMES = 24  # bits of a packed link for how often it occurs
SUMS = 1 << 18  # distinct pairs after which a task gives its sums


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def byte_level(path: str) -> byte_bpe.Merged:
    """The encoder of a tokenizer's JSON. Ids must rise with the order of merges, else lowest id first is not its rule."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, added = byte_alphabet(), {t["id"] for t in spec["added_tokens"]}
    of = lambda token: bytes(letters[c] for c in token)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(b <= a for a, b in zip(made, made[1:])):
        raise ValueError(f"{path}: merges are not in the order of their ids")
    return byte_bpe.Merged(byte_bpe.Vocabulary({of(t): i for t, i in vocab.items() if i not in added}))


@functools.cache
def pieces(path: str):
    """(processor, bytes of each id): U+2581 is a blank, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i, p: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
    return model, pa.array([of(i, model.id_to_piece(i)) for i in range(model.get_piece_size())], pa.binary())


class Windows:
    """Window (ids of A, -1, ids of B) to its alignment: number of groups, the groups as text, and the pair of each link as 64-bit bytes.

    Two generations of MEMO windows: what was used since the last turn stays. Windows that are new are aligned together.
    """

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.size_a, self.size_b = size_a, size_b
        ids = lambda n: pa.array(np.arange(n)).cast(pa.string())
        behind = lambda ids, mark: pc.binary_join_element_wise(ids, mark, "")
        a, b = ids(len(size_a)), ids(len(size_b))
        self.said = pa.concat_arrays([behind(a, ","), behind(a, "|"), behind(b, ","), behind(b, ";"), b])  # an id and what stands behind it
        self.young: dict[bytes, tuple[int, str, bytes]] = {}
        self.older: dict[bytes, tuple[int, str, bytes]] = {}

    def of(self, keys: list[bytes]) -> list[tuple[int, str, bytes]]:
        """Alignments of distinct windows."""
        if len(self.young) > MEMO:
            self.older, self.young = self.young, {}
        young, older, new = self.young, self.older, []
        for key in keys:
            if key not in young:
                if (found := older.get(key)) is not None:
                    young[key] = found
                else:
                    new.append(key)
        if new:
            young.update(zip(new, self.align(new), strict=True))
        return [young[key] for key in keys]

    def align(self, keys: list[bytes]) -> list[tuple[int, str, bytes]]:
        ids = np.frombuffer(b"".join(keys), "<i4")
        n = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        cut = np.flatnonzero(ids == -1)
        n_a = cut - (np.cumsum(n) - n)
        in_a = _runs(n) < np.repeat(n_a, n)
        in_b = ~in_a
        in_b[cut] = False
        a, b = ids[in_a].astype(np.int64), ids[in_b].astype(np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.unique(np.concatenate([end_a, end_b]))  # two tokens are linked up to where the first of them ends
        of_a, of_b = np.searchsorted(end_a, at), np.searchsorted(end_b, at)
        own = np.repeat(np.arange(len(keys)), n_a)[of_a]
        both = (end_a[of_a] == at) & (end_b[of_b] == at)
        shared = at[both]

        # tokens by group, A before B, each with the mark behind it
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        many_a, many_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        begin = np.cumsum(many_a + many_b) - many_a - many_b
        last = np.zeros(len(shared), bool)
        last[np.cumsum(groups := np.bincount(own[both], minlength=len(keys))) - 1] = True
        v_a, v_b = len(self.size_a), len(self.size_b)
        said = np.empty(len(a) + len(b), np.int64)
        said[begin[group_a] + _runs(many_a)] = a + v_a * (end_a == shared[group_a])
        said[(begin + many_a)[group_b] + _runs(many_b)] = b + 2 * v_a + v_b * (end_b == shared[group_b]) * (1 + last[group_b])
        told = self.said.take(pa.array(said))
        ends = np.frombuffer(told.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(n - 1)])]
        texts = pa.Array.from_buffers(pa.string(), len(keys), [None, pa.py_buffer(np.ascontiguousarray(ends)), told.buffers()[2]]).to_pylist()
        pairs = (b[of_b] << 16 | a[of_a]).astype("<i8").tobytes()
        upto = (8 * np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(keys)))])).tolist()
        return list(zip(groups.tolist(), texts, map(pairs.__getitem__, map(slice, upto[:-1], upto[1:])), strict=True))


@functools.cache
def windows(path_a: str, path_b: str) -> tuple[Windows, np.ndarray]:
    """A worker's memo, and which ids of A start with a blank."""
    a, b = byte_level(path_a).vocabulary.pieces, pieces(path_b)[1]
    if len(a) > 1 << 16:
        raise ValueError("ids of A are packed into 16 bits")
    size = lambda x: pc.binary_length(x).to_numpy().astype(np.int64)
    return Windows(size(a), size(b)), pc.starts_with(a, b" ").to_numpy(zero_copy_only=False)


def _bytes(ids: np.ndarray, n: np.ndarray, vocabulary: pa.Array) -> pa.Array:
    """The bytes of n[0], n[1] ... ids each."""
    got = vocabulary.take(pa.array(ids, pa.int32()))
    ends = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    at = np.ascontiguousarray(ends[np.concatenate([[0], np.cumsum(n)])])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), got.buffers()[2] or pa.py_buffer(b"")])


def _runs(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, 0 to n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def align_texts(texts: pa.Array, path_a: str, path_b: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without nulls: (n_a, n_b, n_groups, n_links) in columns; the groups' digests; then links by text: text, pair, times."""
    memo, blank = windows(path_a, path_b)
    encoder, (model, vocab_b) = byte_level(path_a), pieces(path_b)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
    got = byte_bpe.encode_texts(spaced, encoder)
    a, n_a = got.ids.astype(np.int32), got.ids_of_text()
    lists = model.encode(texts.to_pylist(), num_threads=1)
    n_b = np.fromiter(map(len, lists), np.int64, len(lists))
    b = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n_b.sum()))
    want = spaced.cast(pa.binary())
    same = [pc.equal(_bytes(ids, n, v), want).to_numpy(zero_copy_only=False) for ids, n, v in ((a, n_a, encoder.vocabulary.pieces), (b, n_b, vocab_b))]
    ok = same[0] & same[1] & (pc.binary_length(texts).to_numpy() > 0)
    a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
    n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
    counts = np.stack([n_a, n_b, np.zeros_like(n_a), np.zeros_like(n_a)])
    said = [""] * len(texts)
    if not len(a):
        return counts, said, *(np.zeros(0, np.int64),) * 3

    # shared ends, and of those the anchors: texts end there, or the next token starts with a blank
    size_a, size_b = memo.size_a[a], memo.size_b[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    in_b = np.searchsorted(end_b, end_a)
    shared = np.flatnonzero(end_b[np.minimum(in_b, len(end_b) - 1)] == end_a)
    last = np.zeros(len(a), bool)
    last[np.cumsum(n_a[ok]) - 1] = True
    cut = shared[last[shared] | blank[a[np.minimum(shared + 1, len(a) - 1)]]]
    of_text = np.repeat(np.flatnonzero(ok), n_a[ok])[cut]
    wide_a = np.diff(np.concatenate([[-1], cut]))
    wide_b = np.diff(np.concatenate([[-1], in_b[cut]]))

    # a window's ids as one string of bytes: A, -1, B
    wide = wide_a + wide_b + 1
    begin = np.cumsum(wide) - wide
    ids = np.full(wide.sum(), -1, "<i4")
    ids[np.repeat(begin, wide_a) + _runs(wide_a)] = a
    ids[np.repeat(begin + wide_a + 1, wide_b) + _runs(wide_b)] = b
    ends = (4 * np.concatenate([begin, [len(ids)]])).astype(np.int32)
    named = pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).dictionary_encode()
    w = named.indices.to_numpy()
    found = memo.of(named.dictionary.to_pylist())
    groups, told, pairs = zip(*found, strict=True)
    n = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8
    for row, of in ((2, np.array(groups)), (3, n)):
        counts[row] = np.bincount(of_text, of[w], len(texts)).astype(np.int64)

    n_windows = np.bincount(of_text, minlength=len(texts))
    text = pa.array(told, pa.string()).take(named.indices)
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_windows)]).astype(np.int32), text)
    for i, x in enumerate(pc.binary_join(lists, ";")):
        if ok[i]:
            said[i] = hashlib.sha256(x.as_buffer()).hexdigest()

    # links of each text: first the windows that it has, then their pairs
    code, times = np.unique(of_text * len(found) + w, return_counts=True)
    at, w = code // len(found), code % len(found)
    pick = np.repeat((np.cumsum(n) - n)[w], n[w]) + _runs(n[w])
    distinct, number = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_inverse=True)
    code, where = np.unique(np.repeat(at, n[w]) * len(distinct) + number[pick], return_inverse=True)
    total = np.bincount(where, np.repeat(times, n[w])).astype(np.int64)
    return counts, said, code // len(distinct), distinct[code % len(distinct)], total


def packed(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair << TIMES | times, how many numbers stand for each pair): more than the bits hold takes several."""
    most = (1 << TIMES) - 1
    parts = -(-times // most)
    out = np.repeat(pair << TIMES | most, parts)
    ends = np.cumsum(parts) - 1
    out[ends] = pair << TIMES | (times - (parts - 1) * most)
    return out, parts


DOC = "row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>, sums array<bigint>"


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """The kept columns and those of DOC; now and then a row of nulls with the task's sums so far."""
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    held, batch = 0, None

    def added() -> tuple[np.ndarray, np.ndarray]:
        pair, where = np.unique(np.concatenate([p for p, _ in sums]), return_inverse=True)
        return pair, np.bincount(where, np.concatenate([t for _, t in sums])).astype(np.int64)

    def given() -> pa.RecordBatch:
        out, _ = packed(*added())
        columns = [pa.nulls(1, f.type) for f in batch.schema][:-1] + [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int64())), pa.array([out], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in sliced(batches, 2000):
        names, done = [*batch.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "sums"], 0
        for texts in byte_bpe.groups_of(pc.fill_null(batch.column(batch.num_columns - 1), "")):
            counts, said, of, pair, times = align_texts(texts, path_a, path_b)
            links, parts = packed(pair, times)
            n = np.bincount(of, parts, len(texts)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            kept = [c.slice(done, len(texts)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, counts), pa.array(said), pa.ListArray.from_arrays(offsets, pa.array(links)), pa.nulls(len(texts), pa.list_(pa.int64()))], names=names)
            done += len(texts)
            sums.append((pair, times))
            held += len(pair)
            if held > 4 * SUMS:
                sums = [added()]
                held = len(sums[0][0])
                if held > SUMS:
                    yield given()
                    sums, held = [], 0
    if held:
        yield given()


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for each row.

    A is given blank + text, B adds a blank itself. A text that is null or empty, or whose tokens' bytes are not
    those of blank + text in both, has no tokens: its numbers are 0 and its digest ''. Special strings are plain
    text. A text of any length is one row; repeated rows count as often as they stand there. An empty
    table gives no rows; a kept column with the name of a result is left out.
    """
    results = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    keep = tuple(c for c in keep if c not in (*results, "n_best", "count_sum"))
    as_given = {c: f"kept_{i}" for i, c in enumerate(keep)}  # whatever they are called
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    rows = docs.select(*(docs[c].alias(n) for c, n in as_given.items()), F.monotonically_increasing_id().alias("row"), docs[text].alias("__text"))
    kept = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in as_given.items())
    told = save(rows.mapInArrow(lambda batches: _aligned(batches, path_a, path_b), f"{kept}, {DOC}" if kept else DOC), f"{at}/told", "zstd")
    pair, times = lambda c: F.shiftright(c, TIMES), lambda c: c.bitwiseAND(F.lit((1 << TIMES) - 1))
    x = F.col("x")
    counts = told.filter("sums IS NOT NULL").select(F.explode("sums").alias("x")).groupBy(pair(x).alias("pair")).agg(F.sum(times(x)).alias("count"))
    of_b = Window.partitionBy(F.shiftright("pair", 16))
    counts = save(counts.withColumn("best", F.col("count") == F.max("count").over(of_b)), f"{at}/counts")
    few = counts.count() <= FEW
    links = told.filter("row IS NOT NULL").select("row", F.explode("links").alias("x")).select("row", pair(x).alias("pair"), times(x).alias("times"))
    met = links.join(F.broadcast(counts) if few else counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    met = save(met, f"{at}/met")
    told = told.filter("row IS NOT NULL").drop("links", "sums").join(met, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = save(told.select(*(F.col(n).alias(c) for c, n in as_given.items()), *results[:-1], zero("n_best"), zero("count_sum"), results[-1]), f"{at}/out")
    discard(spark, *(f"{at}/{x}" for x in ("told", "counts", "met")))
    return out
