"""Content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of the last ids hits a mask, so equal passages give
equal chunks. A chunk's address is the SHA-256 of its bytes; the store holds each address once, in files
bucketed by address. Recipes, in ascending doc_id order, list a document's addresses, the ids before it and
its Merkle root; manifests hold one root over the recipes of an id range. Reading checks every level.

Files: table of chunks (addr, ids: little-endian unsigned 16 bit); <path>/recipes and <path>/manifests, Parquet.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from querywatch.llm._work import discard, id_buckets, partitions, save, scratch

SPAN, LEAST, MOST, MASK = 16, 128, 4096, 255  # ids under the rolling hash; of a chunk at least and at most; about MASK ids between cuts
STEP = 0x9E3779B97F4A7C15 | 1
PUNCTUATION = string.punctuation.replace("'", "")
LATIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"  # letters whose lower case is one letter of the kind
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that byte-level vocabularies spell as themselves; the others follow from 256 on
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
PAGE = 4096  # documents under one block of a manifest
CACHE = 600_000  # units in each generation of a worker's cache


@functools.cache
def tokenizer(path: str):
    """The library's own, as the file says: special strings of the vocabulary inside a text are single ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a file must say for its texts to be encoded word by word: (normalizers, pre-tokenizers).
WORD_WISE = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)


@functools.cache
def word_wise(path: str) -> tuple[str, ...] | None:
    """The special strings of a tokenizer that lower-cases, drops white space and parts letters from punctuation; None of any other."""
    t = json.loads(tokenizer(path).to_str())
    found = tuple((t[k] or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    added = t["added_tokens"]
    if found != WORD_WISE or t["post_processor"] or any(x["normalized"] or not x["special"] for x in added):
        return None
    return tuple(x["content"] for x in added)


def word_ids(model, word: str) -> bytes:
    """Ids of a lower-case word of Latin letters from the tokenizer's model alone: it is one pre-token."""
    return array("H", [t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()


def whole_ids(texts: list[str], path: str) -> list[bytes]:
    return [array("H", e.ids).tobytes() for k in range(0, len(texts), 10_000) for e in tokenizer(path).encode_batch_fast(texts[k : k + 10_000], add_special_tokens=False)]


class Cache:
    """Ids, as 16-bit bytes, of words and of what else stands between blanks. Two generations of CACHE units: what was used since the last turn stays."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, units: list[str], is_word: np.ndarray, path: str) -> list[bytes]:
        """Ids of each of the distinct units."""
        if len(self.young) > CACHE:
            self.older, self.young = self.young, {}
        young, older, words, rest = self.young, self.older, [], []
        for u, word in zip(units, is_word.tolist()):
            if u not in young:
                if (ids := older.get(u)) is not None:
                    young[u] = ids
                else:
                    (words if word else rest).append(u)
        model = tokenizer(path).model
        young.update((w, word_ids(model, w)) for w in words)
        young.update(zip(rest, whole_ids(rest, path), strict=True))
        return [young[u] for u in units]


@functools.cache
def cache(path: str) -> Cache:
    """One cache per Python worker: it outlives the tasks that the worker runs."""
    return Cache()


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those from start[1] on, and so on."""
    upto = np.cumsum(n)
    return np.repeat(start - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


def ids_of_pieces(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of distinct blank-free pieces, and how many each has. A Latin word and the punctuation behind it are units of their own."""
    head = pc.utf8_rtrim(pieces, PUNCTUATION)
    letters = pc.utf8_is_alpha(head)
    plain = pc.and_(letters, pc.string_is_ascii(head)).to_numpy(zero_copy_only=False).copy()
    doubt = np.flatnonzero(letters.to_numpy(zero_copy_only=False) & ~plain)
    plain[doubt] = pc.match_substring_regex(head.take(pa.array(doubt)), LATIN).to_numpy(zero_copy_only=False)
    words = pc.utf8_lower(head.filter(pa.array(plain)))
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    from_ = offsets[:-1] + pc.binary_length(head).to_numpy()
    tailed = np.flatnonzero(plain & (from_ < offsets[1:]))
    n = (offsets[1:] - from_)[tailed].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ranges(from_[tailed].astype(np.int64), n)]
    tails = pa.Array.from_buffers(pa.string(), len(tailed), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(data)])
    units = pa.concat_arrays([words, tails, pieces.filter(pa.array(~plain))]).dictionary_encode()
    number = units.indices.to_numpy()
    is_word = np.zeros(len(units.dictionary), bool)
    is_word[number[: len(words)]] = True
    found = cache(path).of(units.dictionary.to_pylist(), is_word, path)
    known, long = np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) // 2
    start = np.cumsum(long) - long
    unit, many = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)  # of each piece, the second is its tail
    unit[np.flatnonzero(plain), 0], unit[tailed, 1], unit[np.flatnonzero(~plain), 0] = np.split(number, [len(words), len(words) + len(tailed)])
    if len(pieces):
        many[:, 0] = long[unit[:, 0]]
        many[tailed, 1] = long[unit[tailed, 1]]
    return known[ranges(start[unit].ravel() if len(pieces) else unit.ravel(), many.ravel())], many.sum(1)


def encode_texts(texts: pa.Array | list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text and the end id, as the library's ``encode`` gives them.

    Word by word where the tokenizer allows it: every distinct piece is looked up once, Arrow and numpy deal the
    ids out. Texts with a special string, and all texts of other tokenizers, go through the library whole.
    """
    column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    special = word_wise(path)
    whole = np.full(len(column), special is None)
    for x in special or ():
        whole |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(whole).tolist()
    if at:
        odd = whole_ids(column.take(pa.array(at)).to_pylist(), path)
        column = pc.if_else(pa.array(whole), "", column)
    split = pc.ascii_split_whitespace(column)
    pieces = split.flatten().dictionary_encode()
    known, long = ids_of_pieces(pieces.dictionary, path)
    number = pieces.indices.to_numpy()
    n = long[number]
    ids = known[ranges((np.cumsum(long) - long)[number], n)]
    offsets = split.offsets.to_numpy()
    edges = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]].tolist()
    end = np.array([end_id], np.uint16)
    out = [np.concatenate([ids[a:b], end]) for a, b in pairwise(edges)]
    for k, i in enumerate(at):
        out[i] = np.concatenate([np.frombuffer(odd[k], np.uint16), end])
    return out


@functools.cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 17)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, STEP, np.uint64), np.full(n, pow(STEP, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of STEP and of its inverse; only the usual number is kept in memory."""
    up, down = _usual_powers() if n <= 1 << 17 else _powers(n)
    return up[:n], down[:n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: a function of the ids near each cut and of the cut before."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    up, down = powers(n)
    v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    total = np.cumsum(v * down, dtype=np.uint64)
    total[SPAN:] -= total[:-SPAN].copy()
    hits = np.flatnonzero((total * up) >> np.uint64(40) & np.uint64(MASK) == 0) + 1
    out, at = [], 0
    for h in hits.tolist():
        while h - at > MOST:
            at += MOST
            out.append(at)
        if h - at >= LEAST:
            out.append(at := h)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return out if at == n else [*out, n]


def merkle(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"".join(leaves[i : i + 2])).digest() for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


def _cut_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 1024):
                batch = big.slice(k, 1024)
                sizes, addrs, parts, roots = [], [], [], []
                for ids in encode_texts(batch.column(1), path, end_id):
                    data, ends = ids.astype("<u2").tobytes(), cuts(ids)
                    own = [data[2 * a : 2 * b] for a, b in zip([0, *ends], ends)]
                    names = [hashlib.sha256(p).digest() for p in own]
                    sizes.append(len(ids))
                    addrs.append(names)
                    parts.append(own)
                    roots.append(merkle(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(addrs, pa.list_(pa.binary())), pa.array(parts, pa.list_(pa.binary())), pa.array(roots, pa.binary())],
                    names=["doc_id", "n_tokens", "addrs", "parts", "root"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, addrs array<binary>, parts array<binary>, root binary")


def _manifests(recipes: DataFrame) -> DataFrame:
    """A root per range of ids: SHA-256 over the roots of its blocks, each over at most PAGE documents' roots in order of (doc_id, start)."""
    roots = F.array_sort(F.collect_list(F.struct("doc_id", "start", F.hex("root").alias("root"))))
    blocks = recipes.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(roots["root"], ""), 256).alias("root"))
    roots = F.array_sort(F.collect_list(F.struct("block", "root")))
    return blocks.groupBy("part").agg(F.sum("n").alias("documents"), F.sha2(F.array_join(roots["root"], ""), 256).alias("range_root"))


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> dict[str, str]:
    """Encode and store; returns the chunk table's name and the folders of recipes and manifests.

    Null and empty texts are the end id alone. Nulls in doc_id come first in the order. Repeated rows have
    recipes of their own and share their chunks. Ids must be below 65,536.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    n = partitions(spark)
    cut = save(_cut_documents(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), tokenizer_path, end_id), f"{at}/cut", "zstd")
    table = "chunks_" + at.rpartition("-")[2]
    chunks = cut.select(F.explode(F.arrays_zip("addrs", "parts")).alias("c")).select(F.col("c.addrs").alias("addr"), F.col("c.parts").alias("ids"))
    chunks.groupBy("addr").agg(F.any_value("ids").alias("ids")).write.bucketBy(n, "addr").format("parquet").option("compression", "zstd").saveAsTable(table)
    discard(spark)
    lines = cut.drop("parts").withColumn("row", F.monotonically_increasing_id())
    lines = lines.withColumn("part", id_buckets(cut, "doc_id", n))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = lines.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    place = F.count(F.lit(1)).over(inside)
    starts = lines.withColumns({"start": F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)), "block": F.floor(place / PAGE)}).join(bases, "part")
    recipes = starts.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "addrs", "root", "part", "block").sortWithinPartitions("part", "doc_id", "start")
    recipes = save(recipes, f"{at}/recipes")
    save(_manifests(recipes), f"{at}/manifests")
    discard(spark, f"{at}/cut")
    return {"chunks": table, "recipes": f"{at}/recipes", "manifests": f"{at}/manifests"}


def read(spark: SparkSession, store: dict[str, str]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (unsigned 32 bit, little endian) from the files alone.

    Fails if a range's root, a document's root, a chunk's address or a length differs.
    """
    recipes = spark.read.parquet(store["recipes"])
    found = _manifests(recipes).join(spark.read.parquet(store["manifests"]), ["part", "documents", "range_root"], "full_outer").groupBy("part").count().filter("count > 1")
    if found.limit(1).count():
        raise ValueError("a manifest does not match its recipes")
    chunks = spark.table(store["chunks"])
    bad = F.raise_error(F.lit("a chunk does not match its address")).cast("binary")
    chunks = chunks.select("addr", F.when(F.sha2("ids", 256) == F.lower(F.hex("addr")), F.col("ids")).otherwise(bad).alias("part_ids"))
    asked = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("addrs").alias("seq", "addr"))
    first = {c: F.when(F.col("seq") == 0, F.col(c)) for c in ("n_tokens", "root")}  # once per document is enough
    parts = asked.withColumns(first).join(chunks, "addr", "left").groupBy("doc_id", "start")
    parts = parts.agg(F.max("n_tokens").alias("n_tokens"), F.max("root").alias("root"), F.collect_list(F.struct("seq", "addr", "part_ids")).alias("parts"))
    rows = parts.select("doc_id", "start", "n_tokens", "root", F.array_sort("parts").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, out = [], []
            for n, root, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(p["part_ids"] or b"" for p in parts), "<u2").astype("<u4")
                if len(ids) != n or merkle([p["addr"] for p in parts]) != root:
                    raise ValueError("a document does not match its recipe")
                out.append(ids.tobytes())
                sums.append(zlib.crc32(out[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
