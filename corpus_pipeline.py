"""A corpus from raw documents to token ids: five stages, each one of the operators in ``codevigil.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All
but the last return the columns of ``documents``; the last returns a row per document with its ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codevigil.llm import bpe, contain, parity_join, pii, quality
from codevigil.llm.queries import prepared, public_tokenizer
from codevigil.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepared(spark)
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"), 0.3)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more over five-word shingles hold together."""
    prepared(spark)
    return parity_join.one_per_component(docs, 5, 80, 100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 or more of its five-word shingles."""
    prepared(spark)
    return contain.without_leaks(docs, _table(spark, sf_dir, "benchmark"), 5, 80, 100)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    prepared(spark)
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and decoded, the text that the ids stand for."""
    prepared(spark)
    return bpe.bpe_texts(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: SQL cannot train the classifier; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/codevigil/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
