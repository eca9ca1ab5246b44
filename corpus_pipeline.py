"""The corpus pipeline: five stages over ``documents``, each one a function of ``quillon.llm``.

Every stage gets the whole of what its predecessor kept, written as Parquet and read again. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, near, packing, quality, suffix
from quillon.llm.common import P, checked, free_name, keyed_rows, materialize, quoted, settled, table


def own(docs: DataFrame) -> list[str]:
    """The columns of a table as they are, whatever their names."""
    return [quoted(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and reach the log-likelihood threshold.

    Null, empty and blank texts have no words and go. Long texts are one row's arrays. Ties, repeated rows and null ids are judged row by
    row, so copies share their fate. An empty table stays empty; without labels the base rules decide alone. Columns named like a result
    stay as they are.
    """
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), singles=True)
    return scored.where(F.col(free_name("kept", docs.columns))).select(*own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word Jaccard similarities of 0.8 or more connect: the one with the smallest id.

    Operator 3 (``simhash.document_links``) gives the links within its bits, which are verified; prefix filtering gives the others.

    Null and empty texts are equal, so one of them stays. Null ids come before all others. Rows that agree in id and text are one document, of which
    one row stays; rows with one id and unlike texts are two documents. Long texts are compared as whole sets. An empty table stays empty. No other column is read.
    """
    losers = settled(lambda: near.losers(docs.select("doc_id", "text")), "losers")
    _, unique = keyed_rows(docs)
    return unique.join(checked(losers, losers.count()), P + "doc", "left_anti").select(*own(docs))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start earlier; ``n_chars`` follows the text where the table has it.

    Every row stays. Null texts stay null, texts of fewer than 100 bytes stay whole; cuts never split a character. Rows that agree in id and text are one document
    and are cut alike; null ids come first, ties in id go by hashes of the text. Long texts are cut into overlapping segments. An empty table stays empty. No other column is read.
    """
    out = suffix.without_repeats(suffix.dedup(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*own(docs)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts, and an empty benchmark, hold nothing and stay. Rows that agree in id and text go or stay together. Long texts are searched as a whole. An empty table
    stays empty. No other column is read.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes.

    Null and empty texts are pieces of the separator alone, long texts are cut, repeated rows are packed each, null ids stay null. An empty table gives
    no rows. No other column is read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can't express hashing, tokenising or packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
