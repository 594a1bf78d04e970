"""Bounded samples of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import columns_as


def labelled_sample(docs: DataFrame, labels: DataFrame, label_column: str, rows: int, seed: int) -> DataFrame:
    """label, text of at most ``rows`` labelled documents, the first by a hash of their ids.

    ``rows`` bounds the labels that are broadcast, so just these texts leave the scan. Labels that are
    null or not 0 or 1, and ids without text, are left out.
    """
    known = columns_as(labels, label_doc="doc_id", label=label_column).where("label IN (0, 1) AND label_doc IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("label_doc", F.lit(seed)), "label_doc", "label").limit(rows)
    texts = columns_as(docs, doc_id="doc_id", text="text").where("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_doc")).select("doc_id", "label", "text")
