"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings. Every term of a bounded sample of labelled rows is indexed; document
frequencies are counted over all documents, and a term's weight grows with how surely it goes with one label
(the lower confidence bound of its log odds), down to a floor that all terms keep. The sample's unit vectors
form an inverted index: posting lists cut at blocks of examples, each piece with its largest weight; terms that
very many examples have are kept as whole columns instead. Both together bound what any example of a block can
score; a query scores its best blocks first and then just the blocks whose bound beats the k-th score found, so
its neighbours are exact. Votes weighted by squared similarity are
calibrated on labels of the sample, each voted on by an index that was built without it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from querywatch.llm._work import lean, partitions, release, sliced

SAMPLE = 2000  # labelled rows at most
LONGEST = 1 << 16  # bytes of a text that may be an example; such texts are scored like all others
HEADS = (3, 5)  # letters of word beginnings
SURE = 2.0  # standard errors taken off a term's log odds
FLOOR = 0.02  # weight of a term that goes with neither label
NEAREST = 16
BLOCK = 64
COMMON = 16  # a term that one in so many examples has is a column
FIRST = 2  # blocks scored before the others are bounded by what they gave
FOLDS = 4
ODDS = 3.0  # a toxic example counts so many times in the calibration: missing one is worse than a false alarm
CHUNK = 8192  # terms counted together
CUT = 0.7
QUERIES = 64  # queries that meet the columns together
LETTERS = np.array([b if 97 <= b < 123 or b >= 128 else 32 for b in range(256)], np.uint8)
Counts = tuple[np.ndarray, np.ndarray]  # the terms of a text, by number and in order, and how often each is there


def words_of(texts: pa.Array) -> pa.ListArray:
    """Runs of letters a to z and of characters beyond ASCII, in lower case; nulls as empty texts."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    _, offsets, data = lower.buffers()
    letters = LETTERS[np.frombuffer(data or b"", np.uint8)]
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(lower), [None, offsets, pa.py_buffer(letters)], offset=lower.offset))


def terms_of(texts: pa.Array) -> list[dict[str, int]]:
    """Words of each text with their counts, and beginnings of longer words as ``^abc``."""
    out = []
    for words in words_of(texts).to_pylist():
        words = Counter(w for w in words if w)
        found = Counter(words)
        for w, n in words.items():
            for k in HEADS:
                if len(w) > k:
                    found["^" + w[:k]] += n
        out.append(dict(found))
    return out


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those from start[1] on, and so on."""
    upto = np.cumsum(n)
    return np.repeat(start - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


class Vocabulary:
    """Numbers of the terms in order, words and beginnings apart."""

    def __init__(self, terms: pa.Array):
        heads = pc.starts_with(terms, "^").to_numpy(zero_copy_only=False)
        self.size = len(terms)
        self.words, self.heads = terms.filter(pa.array(~heads)), pc.utf8_slice_codeunits(terms.filter(pa.array(heads)), 1)
        self.number = np.concatenate([np.flatnonzero(~heads), np.flatnonzero(heads)])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """A row per word: its terms, -1 for none."""
        of = lambda x, known, first: np.where(np.isnan(at := pc.index_in(x, known).to_numpy(zero_copy_only=False).astype(float)), -1, at + first).astype(np.int64)
        long = pc.utf8_length(words).to_numpy()
        found = [of(words, self.words, 0), *(np.where(long > k, of(pc.utf8_slice_codeunits(words, 0, k), self.heads, len(self.words)), -1) for k in HEADS)]
        at = np.stack(found, 1)
        return np.where(at >= 0, np.append(self.number, -1)[at], -1)

    def counts(self, texts: pa.Array) -> list[Counts]:
        """terms_of(texts) within the vocabulary, by number."""
        lists = words_of(texts)
        words = lists.flatten().dictionary_encode()
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        term = self.numbers(words.dictionary)[words.indices.to_numpy()]
        there = term >= 0
        key, n = np.unique((text[:, None] * (self.size + 1) + term)[there], return_counts=True)
        edges = np.searchsorted(key, np.arange(len(lists) + 1) * (self.size + 1))
        return [(key[a:b] - i * (self.size + 1), n[a:b]) for i, (a, b) in enumerate(pairwise(edges.tolist()))]


class Index:
    """Unit vectors of the examples as posting lists in pieces: one for each term and block that has it."""

    def __init__(self, df: np.ndarray, documents: int, examples: list[tuple[int, int, Counts]]):
        # alike examples share blocks: by label, then by their most frequent term
        self.examples = sorted((e for e in examples if len(e[2][0])), key=lambda e: (e[1], int(e[2][0][e[2][1].argmax()]), e[0]))
        without = [e[1] for e in examples if not len(e[2][0])]
        self.prior = (sum(without) + 0.5) / (len(without) + 5)
        self.ids, self.labels = [e[0] for e in self.examples], np.array([e[1] for e in self.examples], float)
        toxic, clean = np.zeros(len(df)), np.zeros(len(df))
        for _, y, (at, _) in examples:
            (toxic if y else clean)[at] += 1
        p = sum(y for _, y, _ in examples)
        odds = np.log((toxic + 0.5) / (p + 1)) - np.log((clean + 0.5) / (len(examples) - p + 1))
        sure = np.maximum(0, np.abs(odds) - SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))
        self.weight = (np.log((1 + documents) / (1 + df)) + 1) * (FLOOR + sure)
        vectors = [self.vector(e[2]) for e in self.examples]
        row = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(a) for a, _ in vectors])
        term, w = (np.concatenate([np.zeros(0, kind), *x], dtype=kind, casting="same_kind") for x, kind in (([a for a, _ in vectors], np.int32), ([w for _, w in vectors], np.float32)))
        del vectors
        common = np.flatnonzero(np.bincount(term, minlength=len(df)) * COMMON >= max(1, len(self.examples)))
        self.column = np.full(len(df), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.blocks = -(-len(self.examples) // BLOCK)
        self.columns = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        whole = self.column[term] >= 0
        self.columns[self.column[term[whole]], row[whole]] = w[whole]
        row, term, w = row[~whole], term[~whole], w[~whole]
        order = np.argsort(term.astype(np.int64) * (len(self.examples) + 1) + row)
        self.row, term, self.posting = row[order], term[order], w[order]
        del row, w, order
        piece = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(self.row // BLOCK, prepend=-1))
        self.start, self.size = piece.astype(np.int32), np.diff(np.append(piece, len(term))).astype(np.int32)
        self.block, self.highest = self.row[piece] // BLOCK, np.maximum.reduceat(self.posting, piece) if len(piece) else self.posting
        ends = np.searchsorted(term[piece], np.arange(len(df) + 1))
        self.pieces, self.n_pieces = ends[:-1].astype(np.int32), np.diff(ends).astype(np.int32)
        self.a, self.b = 1.0, 0.0  # calibration; without one the share of votes is the score
        self.calibrated = False

    def __getstate__(self) -> dict:
        """What tasks get: the examples' counts are in the posting lists by then."""
        return self.__dict__ | {"examples": [e[:2] for e in self.examples]}

    def vector(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / max(np.sqrt(w @ w), 1e-300)

    def nearest(self, queries: list[Counts], k: int = NEAREST) -> list[list[tuple[float, int]]]:
        """Of each query: (similarity, example) of the k nearest with any similarity; equals go to the lower number."""
        out = []
        for start in range(0, len(queries), QUERIES):
            vectors = [self.vector(q) for q in queries[start : start + QUERIES]]
            dense = np.zeros((QUERIES, len(self.columns)), np.float32)
            for row, (at, w) in zip(dense, vectors):
                column = self.column[at]
                row[column[column >= 0]] = w[column >= 0]
            out += [self._nearest(at, w, s.astype(float), k) if len(at) else [] for (at, w), s in zip(vectors, dense @ self.columns)]
        return out

    def _nearest(self, at: np.ndarray, w: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``scores``: what the columns give."""
        column = self.column[at]
        at, w = at[column < 0], w[column < 0]
        pieces, w = ranges(self.pieces[at], n := self.n_pieces[at]), np.repeat(w, n)
        block = self.block[pieces]
        bounds = np.bincount(block, w * self.highest[pieces], minlength=self.blocks) + scores.reshape(self.blocks, BLOCK).max(1)
        open_ = np.zeros(self.blocks, bool)
        open_[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        scores += self.scored(pieces, w, open_[block])
        kth = lambda s: np.partition(s, -k)[-k] if len(s) > k else 0.0
        more = (bounds > kth(np.where(np.repeat(open_, BLOCK), scores, 0.0)) - 1e-5) & ~open_  # columns have single precision
        scores += self.scored(pieces, w, more[block])
        scores[~np.repeat(open_ | more, BLOCK)] = 0.0
        near = np.flatnonzero(scores >= max(kth(scores), 1e-300))
        return [(float(scores[i]), int(i)) for i in near[np.lexsort((near, -scores[near]))][:k]]

    def scored(self, pieces: np.ndarray, w: np.ndarray, use: np.ndarray) -> np.ndarray:
        """What the used pieces add to the score of every example."""
        pieces = pieces[use]
        n = self.size[pieces]
        at = ranges(self.start[pieces], n)
        return np.bincount(self.row[at], self.posting[at] * np.repeat(w[use], n), minlength=self.blocks * BLOCK)

    def votes(self, near: list[tuple[float, int]]) -> float:
        w = np.array([s * s for s, _ in near])
        return float(w @ self.labels[[i for _, i in near]] / w.sum())

    def score(self, queries: list[Counts]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Of each query: score and neighbours."""
        found = self.nearest(queries) if self.examples else [[]] * len(queries)
        shares = np.array([self.votes(near) if near else 0.0 for near in found])
        scores = 1 / (1 + np.exp(-(self.a * shares + self.b))) if self.calibrated else shares
        return [(float(s) if near else self.prior, near) for s, near in zip(scores, found)]

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic curve through labels against votes, toxic ones ODDS-fold, by Newton's method with a weak ridge."""
        if len(set(labels.tolist())) < 2:
            return
        x, t, c = np.stack([votes, np.ones(len(votes))], 1), np.zeros(2), np.where(labels > 0, ODDS, 1.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
            step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (c * (p - labels)) + 1e-3 * t)
            t = t - np.clip(step, -5, 5)
        self.a, self.b, self.calibrated = float(t[0]), float(t[1]), True


def frequencies(docs: DataFrame, vocabulary: Vocabulary, terms: int, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are. A task gathers one number per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms + 1, np.int64)  # the last: documents
        for batch in sliced(batches):
            for at, _ in vocabulary.counts(batch.column(0)):
                found[at] += 1
            found[terms] += batch.num_rows
        at = [i for i in range(0, terms + 1, CHUNK) if found[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([found[i : i + CHUNK].astype("<i8").tobytes() for i in at], pa.binary())], names=["at", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[at] = found.get(at, 0) + np.frombuffer(n, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([n.tobytes() for n in found.values()], pa.binary())], names=["at", "n"])

    kind = "at bigint, n binary"
    rows = docs.select(text).mapInArrow(lean(count), kind).repartition(partitions(docs.sparkSession), "at").mapInArrow(lean(total), kind).collect()
    out = np.zeros(terms + 1, np.int64)
    for r in rows:
        n = np.frombuffer(r["n"], "<i8")
        out[r["at"] : r["at"] + len(n)] = n
    return out[:-1], int(out[-1])


def _examples(rows: list) -> tuple[pa.Array, list[tuple[int, int, Counts]]]:
    """All terms in order; of each example its id, label and counts."""
    counts = [np.frombuffer(r["counts"], "<i4").astype(np.int64) for r in rows]
    found = pa.concat_arrays([pa.array([], pa.string()), *(pa.array(r["terms"].split("\n") if r["terms"] else [], pa.string()) for r in rows)]).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number, ends, out = rank[found.indices.to_numpy()], np.cumsum([0, *map(len, counts)]), []
    for r, n, a, b in zip(rows, counts, ends, ends[1:]):
        by = np.argsort(number[a:b])
        out.append((r["id"], int(r["toxic"] == 1), (number[a:b][by], n[by])))
    return found.dictionary.take(pa.array(order)), out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> tuple[Vocabulary, Index]:
    """``labels``: doc_id and toxic (0 or 1; null rows are left out, of repeated ids 1 wins), learnable rows only.

    The sample is the rows of least hash, ``sample`` at most of LONGEST bytes at most each: all that reaches the
    driver and the broadcast is bounded by that, however large the tables are. Texts count as empty where null.
    """
    h = F.xxhash64(F.lit(5), "__id")
    rows = labels.filter(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    part = F.lit(int(min(1.0, 1.2 * sample / max(rows.count(), 1)) * (1 << 20)))
    chosen = rows.filter(F.pmod(h, F.lit(1 << 20)) <= part).orderBy(F.pmod(h, F.lit(1 << 20)), "__id").limit(sample)
    own = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id").filter(F.octet_length("__text") <= LONGEST)
    own = own.groupBy("__id").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.first("__toxic").alias("__toxic"))  # ids may repeat

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = terms_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(["\n".join(f) for f in found]), pa.array([np.array([*f.values()], "<i4").tobytes() for f in found], pa.binary())], names=["id", "toxic", "terms", "counts"])

    got = own.select("__id", "__text", "__toxic").mapInArrow(lean(vectors), f"id {dict(docs.dtypes)[doc_id]}, toxic int, terms string, counts binary").collect()
    terms, examples = _examples(sorted(got, key=lambda r: r["id"]))
    vocabulary = Vocabulary(terms)
    df, documents = frequencies(docs, vocabulary, len(terms), text)
    index = Index(df, documents, examples)
    votes, truth, folds = [], [], np.random.default_rng(1).permutation(len(examples)) % FOLDS
    for fold in range(FOLDS):
        other = Index(df, documents, [e for e, f in zip(examples, folds) if f != fold])
        asked = [e for e, f in zip(examples, folds) if f == fold and other.examples]
        for (_, y, _), near in zip(asked, other.nearest([e[2] for e in asked])):
            if near:
                votes.append(other.votes(near))
                truth.append(float(y))
        del other
    index.calibrate(np.array(votes), np.array(truth))
    release()
    return vocabulary, index


def score(docs: DataFrame, trained: tuple[Vocabulary, Index], text: str = "text", keep: tuple[str, ...] = ("doc_id",), evidence: bool = False, into: str = "score") -> DataFrame:
    """The columns ``keep`` with ``into`` (0 to 1) and, if asked for, evidence: (doc_id, label, similarity) of the neighbours.

    Null and empty texts, and texts without a known term, get the prior of such examples. A text of any length is
    read whole; repeated rows score alike; an empty table gives no rows. A kept column with the name of a result is
    left out: name the result otherwise to keep it.
    """
    results = [(into, "double"), ("evidence", "array<struct<id:bigint,label:int,similarity:double>>")][: 1 + evidence]
    keep = tuple(c for c in keep if c not in [n for n, _ in results])
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), *(f"`{n}` {t}" for n, t in results)])
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))
    vocabulary, index = trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = index.score(vocabulary.counts(batch.column(batch.num_columns - 1)))
            columns = [*batch.columns[:-1], pa.array([s for s, _ in found], pa.float64())]
            if evidence:
                columns.append(pa.array([[{"id": index.ids[i], "label": int(index.labels[i]), "similarity": s} for s, i in near] for _, near in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *(n for n, _ in results)])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(lean(run), schema)
