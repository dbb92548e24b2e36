"""The registered queries of this subpackage: each operator over its whole table, with production
parameters, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import ann, decontaminate, hilbert_shards, ngram_join, quality, secrets, sentence_spans, sentencepieces, token_counts, warc


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the files stay where the box has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shards(table(spark, sf_dir, "documents"), ["lang", "source"])


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_hilbert_sharding, op3_warc_dictionary, op4_sentencepiece_offsets, op5_secret_forest, op6_winnowing_decontamination, op7_kmeans_tree_ann, op8_quality_rff, op9_prefix_token_counts, op10_sentence_spans)}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_winnowing_decontamination": decontaminate.ORACLE,
    "op3_warc_dictionary": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        c AS (SELECT payload_digest, max(page_id) AS chosen FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, d.payload_digest,
               CASE WHEN chosen IS NULL OR chosen = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN chosen <> page_id THEN chosen END AS refers_to
        FROM d LEFT JOIN c ON d.payload_digest = c.payload_digest""",
}
