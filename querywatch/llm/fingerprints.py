"""Bottom-k sketches of word-shingle hashes with DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance, containment
and the distinct shingle count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from querywatch.llm._work import id_buckets, partitions

K = 128
WIDTH = 5
RANGE = float(2**64)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Words are split at white space after lower-casing; fewer than ``width`` words are one shingle; no word, no hash."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        # one row of arrays: h shifted by 0..width-1, combined position by position
        long = F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(*[F.get(h, i + j - 1) for j in range(width)]))
        return F.when(F.size(h) >= width, long).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))

    # transform over a one-element array binds the word hashes once
    return F.transform(F.array(hashes), lambda h: F.slice(F.array_sort(F.array_distinct(shingles(h))), 1, k))[0]


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact below k distinct shingles; two empty sketches are alike (1)."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the k-th hash's share of the hash range."""
    share = (F.element_at(a, -1).cast("double") + RANGE / 2) / RANGE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def with_next(df: DataFrame, columns: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Adds next_<column>: the values of the row that follows in descending doc_id, after the last the first's.

    Rows are dealt to buckets of the id range; each bucket is ordered on its own, and one row per bucket
    (its first) is carried over to the bucket before. Nulls come last; rows with equal ids follow each other
    in the order of their first given column.
    """
    n = 4 * partitions(df.sparkSession)
    df = df.withColumn("__b", id_buckets(df, doc_id, n))
    order = [F.col(doc_id).desc_nulls_last(), F.col(columns[0])]
    w = Window.partitionBy("__b").orderBy(*order)
    row = F.struct(*[F.col(c) for c in columns])
    # the first row of each bucket, found without its texts passing a window of all buckets
    heads = df.groupBy("__b").agg(F.max_by(row, F.struct(F.coalesce(F.col(doc_id), F.lit(-(2**63))), F.lit(0))).alias("__head"))
    tops = df.groupBy("__b").agg(F.lit(1)).select("__b")
    up = Window.orderBy(F.col("__b").desc())  # one row per bucket
    chain = tops.select("__b", F.coalesce(F.lead("__b").over(up), F.max("__b").over(Window.partitionBy())).alias("__from"))
    heads = chain.join(heads.withColumnRenamed("__b", "__from"), "__from").select("__b", "__head")
    inside = df.withColumn("__next", F.lead(row).over(w)).withColumn("__tail", F.lead(F.lit(1)).over(w).isNull())
    out = inside.join(heads, "__b", "left").withColumn("__next", F.when(F.col("__tail"), F.col("__head")).otherwise(F.col("__next")))
    return out.select(*[c for c in df.columns if c != "__b"], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The last third of the code points gives way to as many (or all) first ones of the following text."""
    m = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - m).cast("int")), F.substring(following, F.lit(1), m))


def fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """doc_id, n_chars, sketch per row: null text counts as empty, its sketch is empty; repeated rows stay."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.char_length(t).cast("bigint").alias("n_chars"), sketch(t, k).alias("sketch"))
