"""Corpus pipeline: quality rules, near-dedup, secret scans, mixing and tokenization of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Quality rules drop documents and lines, near-dedup drops documents, the secret
scan masks spans in the texts, mixing orders all rows, and the last stage encodes the texts. As
files are not read again in order, it states each row's place in the mix: by mix_slot (null last),
source and mix_n. Nulls in any column, empty tables and further columns of any name are handled by
the operators (see there); documents without text do not pass the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import bpe, common, mixing, neardup, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.interleave(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_table(mixing.positions(docs.select("doc_id", "source", "text")), carried=("mix_slot", "mix_n"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
ORACLE_SQL = None  # signatures, a trained model and BPE are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
