"""Corpus pipeline: each stage reads what its predecessor wrote as Parquet.

Nulls, empty and long texts, repeated rows, empty tables and extra columns with any name are treated as the
operators say; all stages but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from querywatch.llm import byte_bpe, exact_dedup, jaccard_join, mixing, queries, toxicity
from querywatch.llm._work import save, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; learnt from the labels that are not held out. All columns stay as they are."""
    trained = toxicity.train(docs, queries.table(spark, sf_dir, "labels").filter(~queries.held_out()))
    kept = toxicity.score(docs, trained, keep=tuple(docs.columns), into="__toxicity")
    return kept.filter(F.col("__toxicity") < toxicity.CUT).drop("__toxicity")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text."""
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component; texts without words stay."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One pass of nine tenths of the tokens, weights by the square root of a node's tokens; texts are kept whole."""
    return mixing.select(docs, mixing.Target(share=0.9, epochs=1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, keep=("doc_id", "lang", "source"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = queries.table(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, f"{at}/stage-{i}")
    return docs
