"""Language identification by a byte convolutional network.

Filters of several widths slide over one-hot bytes, the maximum over a window's positions feeds a softmax
layer. Training is plain numpy (Adam) on windows of a bounded sample of labelled rows. Scoring cuts each whole
text into fixed-length windows that overlap by the widest filter; a document's class is the largest mean
log-probability over its windows. A filter over one-hot input is a sum of table rows, so pairs of bytes share
one precomputed table and a position costs a few row reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querywatch.llm._work import sliced

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 192
SAMPLE = 6000  # labelled rows at most that training reads, spread over the languages
SYMBOLS = 26 + 2 + 128
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _symbols() -> np.ndarray:
    t = np.full(256, 26, np.int32)
    t[65:91] = t[97:123] = np.arange(26)
    t[48:58] = 27
    t[128:] = np.arange(28, 156)
    return t


SYMBOL = _symbols()


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one aligned with its end; a short text is padded with blanks."""
    x = SYMBOL[np.frombuffer(data, np.uint8)]
    if len(x) < WINDOW:
        x = np.concatenate([x, np.full(WINDOW - len(x), 26, np.int32)])
    step = WINDOW - max(WIDTHS) + 1
    at = [*range(0, len(x) - WINDOW, step), len(x) - WINDOW]
    return x[np.array(at)[:, None] + np.arange(WINDOW)]


class Network:
    """Weights: for each width an array (width, symbols, filters), biases, and the softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = [r.normal(0, 0.1, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.v = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01) -> None:
        r = np.random.default_rng(11)
        weights = [*self.p, self.b, self.v, self.c]
        m1, m2, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                xs, n = x[rows], len(rows)
                tops, where = [], []
                for w, (width, p) in enumerate(zip(WIDTHS, self.p)):
                    a = sum(p[j][xs[:, j : WINDOW - width + 1 + j]] for j in range(width))
                    where.append(a.argmax(1))
                    tops.append(np.take_along_axis(a, where[-1][:, None], 1)[:, 0] + self.b[w])
                h = np.concatenate(tops, 1)
                f = np.maximum(h, 0)
                z = f @ self.v + self.c
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(n), y[rows]] -= 1
                q /= n
                dh = (q @ self.v.T) * (h > 0)
                grads = []
                for w, (width, p) in enumerate(zip(WIDTHS, self.p)):
                    g, d = np.zeros_like(p), dh[:, w * FILTERS : (w + 1) * FILTERS]
                    for j in range(width):
                        np.add.at(g[j], (np.take_along_axis(xs, where[w] + j, 1), np.arange(FILTERS)[None]), d)
                    grads.append(g)
                grads += [dh.sum(0).reshape(self.b.shape), f.T @ q, q.sum(0)]
                t += 1
                for w, g, a, b in zip(weights, grads, m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> None:
        """Sums for pairs of symbols, once per worker."""
        two, three, four = self.p
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        self.pairs = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1)
        self.third = np.ascontiguousarray(three[2])
        self.last = pair(four[2], four[3])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        k = x[:, :-1] * SYMBOLS + x[:, 1:]
        a = self.pairs[k]  # windows, positions, three widths
        two = a[:, :, :FILTERS].max(1)
        three = (a[:, :-1, FILTERS : 2 * FILTERS] + self.third[x[:, 2:]]).max(1)
        four = (a[:, :-2, 2 * FILTERS :] + self.last[k[:, 2:]]).max(1)
        h = np.maximum(np.concatenate([two, three, four], 1) + self.b.ravel(), 0)
        z = h @ self.v + self.c
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(labelled: DataFrame, text: str, lang: str, doc_id: str, sample: int = SAMPLE) -> Network | None:
    """Fit on about ``sample`` rows, as many of each language as there are (null languages are left out).

    Rows are chosen by a hash of their id; two windows of each, at hashed places, reach the driver.
    """
    rows = labelled.filter(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(lang).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.1 * sample / len(counts) / n))])
    h = F.xxhash64(F.lit(3), F.col(doc_id))
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(doc_id)), F.greatest(F.char_length(text) - 150, F.lit(1))).cast("int") + 1
    chosen = rows.filter(F.pmod(h, F.lit(1 << 20)) <= F.element_at(share, F.col(lang)) * (1 << 20)).filter(F.col(text).isNotNull())
    windows = F.array(*[F.substring(text, place(k), F.lit(2 * WINDOW)) for k in (1, 2)])
    once = chosen.groupBy(h.alias("h")).agg(F.min(F.struct(F.col(lang).alias("lang"), windows.alias("t"))).alias("x"))  # ids may repeat
    got = once.orderBy("h").limit(2 * sample).select("h", "x.lang", F.explode("x.t").alias("t")).collect()
    langs = sorted(counts)
    got = [r for r in sorted(got) if LETTER.search(r["t"])]
    net = Network(langs)
    if got:
        net.fit(np.concatenate([windows_of(r["t"].encode())[:1] for r in got]), np.array([langs.index(r["lang"]) for r in got]))
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (the class's share, 0 to 1).

    Null texts and texts without a letter get ``und`` with score 0, as does every row if nothing was learned. A text
    of any length is read whole, window by window; repeated rows score alike; an empty table gives no rows. A kept
    column with the name of a result is left out.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net:
            net.tables()
        for batch in sliced(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if net:
                size, wins, owner = 0, [], []

                def score() -> None:
                    x = np.concatenate(wins)
                    p = np.concatenate([net.log_probabilities(x[a : a + 64]) for a in range(0, len(x), 64)])
                    first = np.concatenate([[0], np.cumsum([len(w) for w in wins])[:-1]])
                    mean = np.add.reduceat(p, first) / np.array([[len(w)] for w in wins])
                    q = np.exp(mean - mean.max(1, keepdims=True))
                    q /= q.sum(1, keepdims=True)
                    for i, best, s in zip(owner, mean.argmax(1), q.max(1)):
                        langs[i], scores[i] = net.langs[best], s

                for i, t in enumerate(texts):
                    if t and LETTER.search(t):
                        wins.append(windows_of(t.encode()))
                        owner.append(i)
                        size += len(wins[-1])
                        if size > 2000:
                            score()
                            size, wins, owner = 0, [], []
                if wins:
                    score()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs), pa.array(scores)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
