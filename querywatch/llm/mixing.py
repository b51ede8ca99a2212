"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, lang, source). Weights are propagated down the tree; what a child cannot supply goes to
its siblings first and to the siblings of its ancestors only when the whole subtree is exhausted. A leaf's
budget is filled from seeded epochs: whole passes while they fit, then a token prefix of one more pass in
that epoch's seeded order. The running sums are distributed: a leaf of any size is cut into ranges of the
seeded hash, each range is ordered alone and starts at the sum of the ranges before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = ("domain", "lang", "source")
RANGE_ROWS = 4000
SPACE = 1 << 40


@dataclass(frozen=True)
class Target:
    """budget in tokens, or as a share of all; weight(path, tokens below) of a node relative to its siblings; passes at most."""

    budget: int | None = None
    share: float = 0.9
    weight: Callable[[tuple, int], float] = lambda path, tokens: tokens**0.5
    epochs: int = 1
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The tables name no domain: sources are dealt to four by their checksum."""
    return F.when(source.isNotNull(), F.concat(F.lit("domain"), F.crc32(source.cast("binary")) % 4))


def n_tokens(text: Column) -> Column:
    """Words of the whole text; null and empty texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def shares(budget: int, weights: list[float], most: list[int]) -> list[int]:
    """Whole tokens by weight, none beyond its most; what one cannot take the others get by weight."""
    out, open_ = [0.0] * len(most), {i for i, m in enumerate(most) if m > 0 and weights[i] > 0}
    left = float(min(budget, sum(most[i] for i in open_)))
    while open_ and left > 1e-6:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= most[i] - out[i]}
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= most[i] - out[i]
            out[i] = float(most[i])
        open_ -= full
    whole = [int(x) for x in out]
    rest = min(budget, round(sum(out))) - sum(whole)
    for i in sorted(range(len(out)), key=lambda i: (whole[i] - out[i], i)):
        if rest > 0 and whole[i] < most[i] and out[i] > 0:
            whole[i] += 1
            rest -= 1
    return whole


def budgets(tokens: dict[tuple, int], target: Target) -> dict[tuple, int]:
    """Budget of each leaf."""
    most = {leaf: n * target.epochs for leaf, n in tokens.items()}

    def below(path: tuple, what: dict[tuple, int]) -> int:
        return sum(n for leaf, n in what.items() if leaf[: len(path)] == path)

    def fill(path: tuple, budget: int) -> dict[tuple, int]:
        if path in most:
            return {path: budget}
        children = sorted({leaf[: len(path) + 1] for leaf in most if leaf[: len(path)] == path}, key=lambda p: tuple((x is None, x or "") for x in p))
        got = shares(budget, [target.weight(c, below(c, tokens)) for c in children], [below(c, most) for c in children])
        return {k: v for c, b in zip(children, got, strict=True) for k, v in fill(c, b).items()}

    total = sum(tokens.values())
    return fill((), target.budget if target.budget is not None else int(target.share * total)) if tokens else {}


def mix(docs: DataFrame, target: Target = Target(), text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """A row per document and epoch that is taken: doc_id, domain, lang, source, epoch, start, n_tokens, taken, and ``keep``.

    start is the token position in the leaf's epoch; taken is below n_tokens only for the document that a
    prefix ends in. Null languages and sources are leaves of their own; texts without a token are taken with
    the first pass that begins. Equal ids (repeated rows) follow each other. The number of leaves must fit
    the driver; nothing else is collected.
    """
    spark = docs.sparkSession
    extra = [F.col(c).alias(f"__keep_{c}") for c in keep]
    rows = docs.select(F.col(doc_id).alias("doc_id"), domain_of(F.col("source")).alias("domain"), "lang", "source", n_tokens(F.col(text)).alias("n_tokens"), *extra)
    found = {tuple(r[x] for x in LEVELS): (r["tokens"], r["rows"]) for r in rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()}
    plan = budgets({k: v[0] for k, v in found.items()}, target)
    leaves = [(*k, plan[k] // v[0] if v[0] else 1, plan[k] % v[0] if v[0] else 0, max(1, v[1] // RANGE_ROWS)) for k, v in found.items()]
    # as an Arrow table: a list of rows would start a second set of Python workers on every executor to pass it on
    schema = pa.schema([(x, pa.string()) for x in LEVELS] + [(x, pa.int64()) for x in ("passes", "rest", "ranges")])
    table = pa.Table.from_pylist([dict(zip(schema.names, leaf, strict=True)) for leaf in leaves], schema)
    table = F.broadcast(spark.createDataFrame(table).select(*[F.col(x).alias(f"l_{x}") for x in LEVELS], "passes", "rest", "ranges"))
    on = [F.col(x).eqNullSafe(F.col(f"l_{x}")) for x in LEVELS]
    last = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    rows = rows.join(table, on[0] & on[1] & on[2]).filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    h = F.pmod(F.xxhash64(F.lit(target.seed), "epoch", "doc_id"), F.lit(SPACE))
    rows = rows.withColumn("h", h).withColumn("range", F.floor(F.col("h") / SPACE * F.col("ranges")))
    by = [*LEVELS, "epoch"]
    sums = rows.groupBy(*by, "range").agg(F.sum("n_tokens").alias("all"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in (*by, "range")], F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    same = F.col("range") == F.col("s_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    inside = Window.partitionBy(*by, "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, same).withColumn("start", F.col("start") + F.col("base"))
    taken = F.when(F.col("epoch") < F.col("passes"), F.col("n_tokens")).otherwise(F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("start"))))
    rows = rows.withColumn("taken", taken).filter((F.col("taken") > 0) | (F.col("n_tokens") == 0) & (F.col("epoch") == 0))
    return rows.select("doc_id", *LEVELS, "epoch", "start", "n_tokens", "taken", *[F.col(f"__keep_{c}").alias(f"kept_{c}") for c in keep])


def select(docs: DataFrame, target: Target = Target(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that the first pass takes, whole and with their columns."""
    kept = tuple(docs.columns)
    rows = mix(docs, target, text, doc_id, keep=kept).filter("epoch = 0")
    return rows.select(*[F.col(f"kept_{c}").alias(c) for c in kept])
