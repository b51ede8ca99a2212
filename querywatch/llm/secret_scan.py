"""Secret scan with DataFrame functions only: key patterns plus a randomness test battery.

Candidates of the battery are maximal runs of 20 or more characters of the base-64 alphabets. The encoding
of each is inferred (hex, base 32, alphanumeric, base 64), and under the hypothesis that its symbols are
independent and uniform over that alphabet three statistics are taken: chi-squared uniformity with its exact
mean and variance, runs about the median symbol, and lag-1 serial correlation. Their squared scores give one
p-value. Ordinary strings get tiny p-values, random ones any. Within each length octave two bounds decide what
is reported as kind ``random``. Benjamini-Hochberg at FDR picks the strings that are rejected as not random, so
that a true secret is dismissed at a controlled rate whatever its length. Of what is left, the number of random
strings is known from the upper half of the p-values, where hardly any other falls: strings are reported from
the largest p-value down only while those beyond that number stay below FALSE of the reported ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01  # random strings that are dismissed
FALSE = 0.1  # others among the reported strings
BINS = 300  # tenths of decades of p
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, kind: str, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Array of (start, end, rank, token) of the leftmost non-overlapping matches, in code points, end exclusive."""
    p = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.transform(F.split(text, pattern), lambda x: F.char_length(x))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    zipped = F.arrays_zip(hits.alias("hit"), value.alias("value"), F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,token:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), x["hit"].alias("token"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"], x["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(empty)


def _two_sided(z: Column) -> Column:
    """Upper tail of |z|, logistic approximation of the normal distribution."""
    a = F.abs(z)
    return 1 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a)) * 2


def p_random(token: Column) -> Column:
    """p-value of "independent and uniform over the inferred alphabet"."""
    alphabet = (
        F.when(token.rlike("^[0-9a-f]+$"), DIGITS + LOWER[:6]).when(token.rlike("^[0-9A-F]+$"), DIGITS + UPPER[:6]).when(token.rlike("^[A-Z2-7]+$"), UPPER + "234567")
        .when(token.rlike("^[A-Za-z]+$"), UPPER + LOWER).when(token.rlike("^[A-Za-z0-9]+$"), UPPER + LOWER + DIGITS).when(token.rlike("[-_]"), UPPER + LOWER + DIGITS + "-_+/").otherwise(UPPER + LOWER + DIGITS + "+/")
    )

    def tests(s: Column) -> Column:
        x, k, n = s["x"], s["k"].cast("double"), F.size(s["x"]).cast("double")
        counts = F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        chi = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) * k / n - n
        z1 = F.greatest(F.lit(0.0), (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        high = F.transform(x, lambda v: (v > k / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda a, b: a + b).cast("double")
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.size(F.filter(pairs, lambda q: (q["a"] > k / 2) != (q["b"] > k / 2))) + 1
        mu = 2 * n1 * (n - n1) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        z2 = F.when(var > 0, (runs - mu) / F.sqrt(var)).otherwise(12.0)
        mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / n
        square = F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
        lag = F.aggregate(pairs, F.lit(0.0), lambda a, q: a + (q["a"] - mean) * (q["b"] - mean))
        z3 = F.when(square > 0, (lag / square + 1 / n) * F.sqrt(n)).otherwise(12.0)
        return bound(z1 * z1 + z2 * z2 + z3 * z3, lambda q: F.greatest(F.lit(1e-300), F.least(F.lit(1.0), _two_sided(F.sqrt(q)) + F.sqrt(2 * q / math.pi) * F.exp(-q / 2))))

    def indexed(a: Column) -> Column:
        x = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.position(c, a))
        return bound(F.struct(x.alias("x"), F.char_length(a).alias("k")), tests)

    return bound(alphabet, indexed)


def _octave(token: Column) -> Column:
    return F.floor(F.log2(F.char_length(token).cast("double"))).cast("int")


def threshold(counts: dict[int, int], fdr: float = FDR, false: float = FALSE) -> float:
    """p up to which strings are dismissed; ``counts`` by bin, the tenths of decades of p, so that bins 0 to 2 are its upper half."""
    edge = lambda k: 10.0 ** (-k / 10)
    total, below, out = sum(counts.values()), 0, 0.0
    for k in sorted(counts, reverse=True):
        below += counts[k]
        if edge(k) <= fdr * below / total:
            out = edge(k)
    upper = sum(n for k, n in counts.items() if k <= 2)
    random = 2 * (upper + 2 * math.sqrt(upper) + 1)  # as many as there may well be
    reported = 0
    for k in sorted(counts):
        reported += counts[k]
        if k > 2 and reported - random * (1 - edge(k + 1)) > false * reported:
            return max(out, edge(k))
    return out


def thresholds(scored: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Threshold of each length octave; ``scored`` has octave, p. At most BINS + 1 counts of an octave reach the driver."""
    bins = scored.groupBy("octave", F.least(F.lit(BINS), F.floor(-F.log10("p") * 10)).cast("int").alias("bin")).count()
    found: dict[int, dict[int, int]] = {}
    for r in bins.collect():
        found.setdefault(r["octave"], {})[r["bin"]] = r["count"]
    return {octave: threshold(counts, fdr) for octave, counts in found.items()}


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = FDR) -> DataFrame:
    """The columns ``keep``, base and random: arrays of (start, end, rank, token).

    Null text counts as empty and has no span; a text of any length is read whole. Rows are judged one by one
    (repeated rows alike); only the thresholds are corpus-wide. An empty table gives no rows; other columns are
    ignored, and a kept column named base or random gives way to the result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = tuple(c for c in keep if c not in ("base", "random"))
    rows = docs.select(*keep, t.alias("__t"))
    # one pass finds the few texts with a long run at all
    run = F.col("__t").rlike(RUN)
    none = F.array().cast("array<struct<start:int,end:int,rank:int,token:string>>")
    always = lambda hit, value: F.lit(True)
    # a run of letters of one case, or of digits alone, is a word or a number
    mixed = lambda hit, value: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") | hit.rlike("[a-z][A-Z]")
    if_run = lambda c: F.when(run, c).otherwise(none)
    runs = if_run(located(F.col("__t"), RUN, "random", mixed))
    tokens = rows.filter(run).select(F.explode(runs).alias("s")).select("s.token")
    limit = thresholds(tokens.select(_octave(F.col("token")).alias("octave"), p_random(F.col("token")).alias("p")), fdr)
    worst = F.lit(0.0)
    if limit:
        table = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
        worst = lambda s: F.coalesce(F.element_at(table, _octave(s["token"])), F.lit(0.0))
    passes = (lambda s: p_random(s["token"]) > worst(s)) if limit else (lambda s: F.lit(True))
    base = F.concat(
        located(F.col("__t"), ASSIGN, "assign", lambda hit, value: F.char_length(value) >= 6, 2),
        if_run(located(F.col("__t"), ACCESS, "access", always)), if_run(located(F.col("__t"), HEX, "hex", always)),
    )
    return rows.select(*keep, F.array_sort(base).alias("base"), F.filter(runs, passes).alias("random"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
