"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. The distinct blocks are sorted and
get integer names; adjacent names are paired, the distinct pairs sorted and named again, until each
document has one name. Names of one depth are equal exactly if the texts under them are equal, so no hash
decides anything: two 64-bit hashes only route rows to the name of their block, and the job checks that
they tell all distinct blocks apart (else it takes the next seed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from querywatch.llm._work import discard, save, scratch

BLOCK = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _routes(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block), F.xxhash64(block, F.lit(seed + 1))]


def _named(df: DataFrame, by: list[str], keep: list[str], path: str) -> DataFrame:
    """Distinct rows, sorted within their partitions, with an integer name each."""
    return save(df.distinct().sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("name")), path)


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """row_id, doc_id, text_sha256, depth, name: rows with equal (depth, name) have equal normalised texts."""
    at, spark = scratch(docs.sparkSession), docs.sparkSession
    pattern = F.lit("(?s).{1,%d}" % block)
    texts = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("t"))
    seed, names, keyed = 42, None, None
    while names is None:
        cut = texts.select(F.explode(F.regexp_extract_all("t", pattern, F.lit(0))).alias("block"))
        h1, h2 = _routes(F.col("block"), seed)
        found = _named(cut.select(h1.alias("h1"), h2.alias("h2"), "block"), ["block"], ["h1", "h2"], f"{at}/names-{seed}")
        if found.groupBy("h1", "h2").count().filter("count > 1").limit(1).count() == 0:
            names = found
            route = lambda b: F.struct(*[h.alias(n) for h, n in zip(_routes(b, seed), ("h1", "h2"))])  # noqa: B023, E731
            keyed = texts.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(F.regexp_extract_all("t", pattern, F.lit(0)), route).alias("h"))
            keyed = save(keyed.withColumn("row_id", F.monotonically_increasing_id()), f"{at}/keyed")
        seed += 2
    n = F.size("h").alias("n")
    level = keyed.select("row_id", n, F.posexplode("h").alias("pos", "b")).select("row_id", "n", F.col("pos").cast("bigint").alias("pos"), "b.h1", "b.h2")
    level = save(level.join(names, ["h1", "h2"]).select("row_id", "n", "pos", "name"), f"{at}/level-0")
    most = keyed.agg(F.max(n).alias("n")).first()["n"] or 0
    depth = 0
    done = keyed.filter(F.size("h") == 0).select("row_id", F.lit(-1).alias("depth"), F.lit(-1).cast("bigint").alias("name"))
    while True:
        done = done.unionByName(level.filter("n = 1").select("row_id", F.lit(depth).alias("depth"), "name"))
        if most <= 1:
            break
        depth, most = depth + 1, (most + 1) // 2
        pairs = level.filter("n > 1").groupBy("row_id", "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = save(pairs, f"{at}/pairs-{depth}")
        names = _named(pairs.select("l", "r"), ["l", "r"], ["l", "r"], f"{at}/names-of-{depth}")
        discard(spark)
        level = save(pairs.join(names, ["l", "r"]).select("row_id", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), "pos", "name"), f"{at}/level-{depth}")
    found = save(keyed.drop("h").join(done, "row_id"), f"{at}/identities")
    discard(spark, *(f"{at}/{x}" for x in ("keyed", *(f"names-{s}" for s in range(42, seed, 2)), *(f"{x}-{d}" for d in range(depth + 1) for x in ("level", "pairs", "names-of")))))
    return found


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. The smallest doc_id stays (nulls last);
    of repeated rows with that doc_id one is kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = identities(docs, text, doc_id, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    groups = rows.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("group_size"), first)
    return rows.join(groups, ["depth", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``mark`` keeps, with their columns as they were."""
    kept = mark(docs, text, doc_id).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = docs.withColumn("__own", F.sha2(normalised(F.col(text)), 256))
    joined = rows.join(kept, (F.col("__own") == F.col("__sha")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_semi")
    w = Window.partitionBy("__own", doc_id).orderBy(F.lit(1))
    return joined.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
