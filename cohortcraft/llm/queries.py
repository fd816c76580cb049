"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, collocations, conversation_trie, decontaminate, jaccard_join, license_scan, oracle, packing, pii, quality,
               secret_scan, toxicity, url_filter, warc)
from .common import read_table

#: Rank file used by the BPE query and stage, from the public tokenizers at hand.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Tokenizer file used by the packing query.
TOKENIZER_FILE = "byte_bpe_50k.json"


def rank_file() -> tuple[str, str]:
    """(path of the rank file, pre-token pattern)."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def tokenizer_file() -> tuple[str, str]:
    """(path of the tokenizer file that packing uses, pre-token pattern)."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(texts(spark, sf_dir)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = rank_file()
    return byte_bpe.round_trip(texts(spark, sf_dir), path, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(texts(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(texts(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.remainder(F.col("doc_id")) == 1)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.scan(texts(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(texts(spark, sf_dir))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_pairs(texts(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file()
    pieces = packing.pack(texts(spark, sf_dir), path, pattern)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_byte_bpe, op3_url_filters, op4_license_scans, op5_ngram_jaccard_join, op6_toxicity, op7_warc,
    op8_pii, op9_quality_rules, op10_benchmark_decontamination, op11_collocations, op12_packing,
    op13_conversation_trie)}

ORACLE_SQL = {"op7_warc": oracle.OP7, "op11_collocations": oracle.OP11, "op13_conversation_trie": oracle.OP13}
