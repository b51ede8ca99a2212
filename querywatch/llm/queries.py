"""Registered queries of this subpackage: thin wrappers that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts may be long: bound the bytes that a Python worker gets at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import fingerprints as fp

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumns({"n_chars": F.char_length("text").cast("bigint"), "fp": fp.sketch(F.col("text"))})
    rows = fp.with_next(rows, ["text", "fp"]).withColumn("edited", fp.edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fp.sketch(F.col("edited")).alias("efp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fp.as_text(F.col("fp")).alias("fingerprint"), fp.as_text(F.col("efp")).alias("edited_fingerprint"),
        fp.resemblance(F.col("fp"), F.col("efp")).alias("near_edited"), fp.resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        fp.distinct_count(F.col("fp")).alias("n_shingles_est"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import exact_dedup

    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from querywatch.llm import token_store

    store = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, store).drop("ids")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from querywatch.llm import byte_bpe

    rows = byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in sorted(globals().items()) if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_near_vectors": OP13_SQL}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import secret_scan

    rows = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secret_scan.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    spans = F.concat("base", "random")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"), F.size("random").cast("bigint").alias("n_random"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import jaccard_join

    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; rows without an id are held out, too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import langid

    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.filter(~held_out()), "text", "lang", "doc_id")
    return langid.identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    index = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score(docs, index).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes at most, equal weights below each node, as many tokens as there are."""
    from querywatch.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), mixing.Target(share=1.0, weight=lambda path, tokens: 1.0, epochs=2))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; of every seventh row the label moves on by one first."""
    from querywatch.llm import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, scale=256.0)


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from querywatch.llm import cross_tokens

    return cross_tokens.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywatch.llm import near_vectors

    return near_vectors.classes(table(spark, sf_dir, "embeddings"))
