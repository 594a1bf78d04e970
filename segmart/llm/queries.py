"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmart.llm import bpe, exact, licenses, merkle, minhash, packing, pii, quality, quantised, secrets, toxicity, trie, warc
from segmart.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), settings=minhash.NearSettings(percent=85))


def op2_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op3_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, folder, "documents"), "byte_bpe_50k.json"))


def op4_pii_feistel(spark: SparkSession, folder: str) -> DataFrame:
    # A sample key; production passes its own.
    return pii.pseudonymise(table(spark, folder, "documents"), "sample-key").drop("found")


def op5_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(table(spark, folder, "documents"), "word_bpe_49k.json")
    return bpe.digest(bpe.decode(encoded, "word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op7_warc_chains(spark: SparkSession, folder: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, folder, "pages")))


def op8_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.line_quality(docs, quality.fit(docs, table(spark, folder, "labels")))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(table(spark, folder, "documents")))


def op10_license_compression(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


def op12_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_vectors(table(spark, folder, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_curve_packing": op3_curve_packing,
    "op4_pii_feistel": op4_pii_feistel,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc_chains": op7_warc_chains,
    "op8_line_quality": op8_line_quality,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_compression": op10_license_compression,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op6_exact_dedup": exact.SQL,
    "op7_warc_chains": warc.SQL,
    "op11_conversation_trie": trie.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
