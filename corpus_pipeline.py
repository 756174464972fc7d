"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents; the last returns the pieces of packed sequences.

Defined cases: documents with null text, or text without a letter, have no language and go in the first stage, as do those whose
language is not certain (all of them where no document has a label); of equal or near texts the least key stays, of rows with one
key one; rows with a null key are kept by the second stage, since none can name them, and judged as one by the third; an empty
benchmark removes nothing; an empty table gives no pieces; very long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfeed.llm.common import read_table, stage_table
from loomfeed.llm.decontamination import decontaminate
from loomfeed.llm.language import fit, keep_identified
from loomfeed.llm.neardup import drop_near_duplicates
from loomfeed.llm.packing import pack_documents
from loomfeed.llm.pseudonyms import key_of, pseudonymize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; learned from the labelled ones among them."""
    return keep_identified(docs, fit(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pseudonymize(docs, key_of(spark), report=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences for training."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", packing)]
#: SQL cannot express hashing, compression and tokenizing as these stages do them; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
