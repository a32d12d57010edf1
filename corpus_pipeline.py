"""The corpus pipeline: documents through quality rules, language ID, near-dedup and packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. Nulls, empty and very long texts, repeated
rows and empty tables go as the docstrings of the four operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.language import fit_languages, keep_languages
from millrace.llm.near_dedup import drop_near_duplicates
from millrace.llm.packing import pack, tokens
from millrace.llm.quality import fit_quality, keep_quality
from millrace.llm.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by a model of the labelled rows among them.

    Documents whose text is null or empty go. Without labels of both kinds the model is constant.
    """
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some known language, by a model of the documents' own language column.

    Documents without a word go. Without any labelled document all go, for no language is known.
    """
    return keep_languages(docs, fit_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id; of rows that repeat a doc_id one stays, and all rows without doc_id do."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document, by its tokens. Repeated rows and those without doc_id are packed one by one."""
    return pack(docs, tokens(spark))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-dedup", near_dedup), ("packing", packing)]
#: SQL can express none of the four stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
