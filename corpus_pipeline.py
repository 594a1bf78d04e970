"""The corpus pipeline: quality rules, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmart.llm import exact, minhash, packing, quality, secrets
from segmart.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Copies at 80 % go. A pair at 80 % agrees in a given band with 0.8**5 = 0.328, so it shares none of 40
# with 1e-7; the signature test is 5.8 standard deviations below 80 %.
NEAR = minhash.NearSettings(percent=80, bands=40, rows=5, signature_share=0.63)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line model keep; the model is fitted on labelled documents."""
    return quality.keep_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that `exact_groups` keeps."""
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked at 80 % of their shingles or more."""
    return minhash.drop_near_copies(docs, settings=NEAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of live secrets."""
    return secrets.redact_live(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.digest(packing.pack(docs, "byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

# The line model and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces packed from the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
