"""The training-data queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import exact_dedup, hnsw, langid, lm, mixing, packing, quality, simhash, toxicity, warc
from .common import crc_bucket


def _public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), every_row=True)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _public_tokenizer("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.predict_languages(docs, langid.fit_languages(docs))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    return lm.score_texts(docs, lm.fit(docs, F.coalesce(~held_out, F.lit(True))), held_out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLE = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages
        )
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p
    """,
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
