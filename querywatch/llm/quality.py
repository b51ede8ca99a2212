"""Quality scores from weak labels.

Overlapping heuristics vote good (1), bad (0) or nothing (-1) on each whole text. Expectation-maximisation on
the counts of vote patterns over all documents estimates how often each one votes bad on bad and on good texts,
and the share of good ones; a vote that was not cast says nothing. The posterior of a pattern labels its
documents. On a bounded sample these posteriors train a linear scorer over hashed word shapes, which then reads
every text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from querywatch.llm._work import sliced

SAMPLE = 6000  # rows at most that train the scorer, with at most 2 ** BITS features each
BITS = 14
SYMBOLS = r"[#$%&*|<>{}\[\]^~=\\+@_]"
#: Where the estimates start: a labeller votes bad on this share of the bad and of the good texts, and this share is good.
HITS, FALSE_ALARMS, GOOD = 0.3, 0.02, 0.85


def measures(text: Column) -> dict[str, Column]:
    """What the labellers look at. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    each = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "m_symbols": each(SYMBOLS) / n, "m_capitals": each("[A-Z]") / n, "m_digits": each("[0-9]") / n,
        "m_words": F.size(words), "m_kinds": F.size(F.array_distinct(words)), "m_lines": F.size(lines), "m_unlike": F.size(F.array_distinct(lines)),
        "m_marks": each(r"[#$%&*|<>{}\[\]^~=\\+@]+(?!\S)"), "m_shouted": each(r"(?<!\S)[A-Z]{2,}(?![a-z])"), "m_again": each(r"(?<!\S)(\S+)\s(?=\1(?!\S))"),
        "m_bangs": (F.char_length(t) - F.char_length(F.replace(t, F.lit("!!"), F.lit("")))) / 2, "m_stops": each("[.!?]"),
    }


def votes() -> dict[str, Column]:
    """Labeller to its vote, from the columns of ``measures``."""
    words = F.greatest(F.col("m_words"), F.lit(1))
    of = lambda name: F.col(f"m_{name}") / words
    at_least = lambda n: F.col("m_words") >= n
    alike = F.col("m_unlike") / F.greatest(F.col("m_lines"), F.lit(1))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    return {
        "symbols": vote(F.col("m_symbols") > 0.02, F.col("m_symbols") < 0.004),
        "marks": vote(of("marks") > 0.05, of("marks") < 0.01),
        "capitals": vote(F.col("m_capitals") > 0.2, F.col("m_capitals") < 0.08),
        "shouted": vote(of("shouted") > 0.1, of("shouted") < 0.02),
        "bangs": vote(of("bangs") > 0.02, F.col("m_bangs") == 0),
        "again": vote(of("again") > 0.05, of("again") < 0.02),
        "variety": vote(at_least(20) & (of("kinds") < 0.3), at_least(20) & (of("kinds") > 0.45)),
        "length": vote(F.col("m_words") < 3, at_least(20)),
        "lines": vote((F.col("m_lines") >= 3) & (alike < 0.7), (F.col("m_lines") >= 2) & (alike == 1)),
        "digits": vote(F.col("m_digits") > 0.2, F.col("m_digits") < 0.03),
        "sentences": vote(at_least(40) & (of("stops") < 0.01), at_least(10) & of("stops").between(0.02, 0.5)),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of "good" for each row of ``patterns`` (votes; a row has ``counts`` documents)."""
    bad, good, cast = (patterns == 0).astype(float), (patterns == 1).astype(float), (patterns >= 0).astype(float)
    hit, alarm, prior = np.full(patterns.shape[1], HITS), np.full(patterns.shape[1], FALSE_ALARMS), GOOD
    q = np.full(len(patterns), prior)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + bad @ np.log(alarm / hit) + good @ np.log((1 - alarm) / (1 - hit))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - q).max() < 1e-7:
            return new
        q, w, v = new, (1 - new) * counts, new * counts
        hit, alarm = (w @ bad + 0.5) / (w @ cast + 1), (v @ bad + 0.5) / (v @ cast + 1)
        prior = float((v.sum() + 0.5) / (counts.sum() + 1))
    return q


SHAPE = bytes.maketrans(bytes(range(256)), bytes(ord("a") if 97 <= b < 123 or b >= 128 else ord("A") if 65 <= b < 91 else ord("0") if 48 <= b < 58 else b for b in range(256)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes of the words (letters, capitals, digits folded) and their shares; shares of words that repeat the one before, and of different words."""
    data = text.encode()
    words, shapes = data.split(), Counter(data.translate(SHAPE).split())
    out: Counter = Counter()
    for w, n in shapes.items():
        out[zlib.crc32(w) % (1 << BITS)] += n
        for c in {*w}:
            out[zlib.crc32(b"has" + bytes([c])) % (1 << BITS)] += n
    if words:
        out[zlib.crc32(b"again") % (1 << BITS)] += sum(map(eq, words, words[1:]))
        out[zlib.crc32(b"kinds") % (1 << BITS)] += len({*words})
    return np.fromiter(out, np.int64, len(out)), np.sqrt(np.fromiter(out.values(), float, len(out)) / max(len(words), 1))


def _fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Logistic regression by AdaGrad; the last weight is the bias. Classes weigh alike."""
    w, g2, r = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8), np.random.default_rng(3)
    good = sum(y for *_, y in rows)
    scale = (len(rows) / 2 / max(len(rows) - good, 1), len(rows) / 2 / max(good, 1))
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            at, x, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -50, 50)))
            d = (p - y) * (scale[0] * (1 - y) + scale[1] * y)
            g = d * x
            g2[at] += g * g
            g2[-1] += d * d
            w[at] -= rate * g / np.sqrt(g2[at])
            w[-1] -= rate * d / np.sqrt(g2[-1])
    return w


def posteriors(voted: DataFrame, names: list[str]) -> dict[tuple[int, ...], float]:
    """Posterior by vote pattern; at most 3 ** 11 patterns reach the driver."""
    got = sorted((tuple(r[n] for n in names), r["count"]) for r in voted.groupBy(*names).count().collect())
    if not got:
        return {}
    q = expectation_maximisation(np.array([p for p, _ in got]), np.array([c for _, c in got], float))
    return {p: float(x) for (p, _), x in zip(got, q, strict=True)}


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior, score (both 0 to 1, higher: better) and predicted (1 if score >= 0.5) per row.

    Null text counts as empty: no feature, the bias alone scores it. A text of any length is read whole; repeated
    rows score alike; other columns are ignored; an empty table gives no rows. The scorer learns from the rows of
    least hash of id and text, equal ones once.
    """
    v = votes()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    voted = rows.withColumns(measures(F.col("t"))).select("doc_id", "t", *[c.alias(n) for n, c in v.items()])
    of = posteriors(voted, list(v))
    code = lambda p: sum((x + 1) * 3**i for i, x in enumerate(p))
    table = np.full(3 ** len(v), 0.5)
    for p, x in of.items():
        table[code(p)] = x
    number = sum(((F.col(n) + 1) * 3**i for i, n in enumerate(v)), F.lit(0))
    rows = voted.select("doc_id", number.alias("pattern"), "t")
    n, h = docs.count(), F.xxhash64(F.lit(9), "doc_id", "t")
    some = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) <= F.lit(int(min(1.0, 1.1 * sample / max(n, 1)) * (1 << 20))))
    chosen = some.dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(sample).select("doc_id", "pattern", "t")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["pattern", "at", "x"])

    got = chosen.mapInArrow(hashed, "pattern int, at array<bigint>, x array<double>").collect()
    got = sorted((r["pattern"], r["at"], r["x"]) for r in got)
    w = _fit([(np.array(a, np.int64), np.array(x), table[p]) for p, a, x in got])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            z = np.array([w[at] @ x + w[-1] for at, x in map(features, batch.column(2).to_pylist())])
            s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            p = table[batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "posterior", "score", "predicted"])

    kind = dict(docs.dtypes)[doc_id]
    return rows.mapInArrow(score, f"doc_id {kind}, posterior double, score double, predicted int")
