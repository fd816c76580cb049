"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

toxicity -> n-gram Jaccard join -> benchmark decontamination -> secret scans -> byte-level BPE

Toxic documents go, one document of each group of near copies stays,
documents that hold benchmark items go, secrets are masked in the text
(no document goes for them), and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcraft.llm import byte_bpe, decontaminate, jaccard_join, secret_scan, toxicity
from cohortcraft.llm.common import read_table, written
from cohortcraft.llm.queries import rank_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; its labels never cover the held-out third."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars as of the masked text."""
    masked = secret_scan.redact(secret_scan.scan(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian u32) and whether the ids decode to the text."""
    path, pattern = rank_file()
    encoded = byte_bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "decodes")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaked),
    ("secret_scans", mask_secrets),
    ("byte_bpe", encode),
]

#: SQL cannot express the classifier, the similarity join or the encoding; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; every stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
