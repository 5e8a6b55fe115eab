"""From raw documents to packed training sequences: quality, exact and near duplicates, source mix, packing.

Each stage works on all that the stage before kept, which is written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, packing, quality, similar
from lodestone.llm.common import work_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score below quality.THRESHOLD go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_quality(docs, labels))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of documents linked by a five-word-shingle similarity of 0.8 or more that with the least id stays.

    The fingerprints' trie links the closest; what a fingerprint can't reach is found by shared shingles; each link is checked.
    """
    return similar.drop_near_duplicates(docs, words=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the documents in mixed order, so that every run of rows holds the sources by their weights."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of all documents and their places in sequences of 2048 tokens.

    Runs of the mixed order are packed each for itself, and numbers of sequences ascend from run to run, so that sequences
    keep to the mix however the files are dealt to tasks.
    """
    return packing.pack_documents(packing.in_runs(docs), public_tokenizers.path("word_bpe_49k.json"), window=F.col("window"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_once),
    ("SimHash near-dedup", near_once),
    ("mixing sources", source_mix),
    ("best-fit packing", packed),
]

#: A trained classifier and token ids are beyond SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = work_dir(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
