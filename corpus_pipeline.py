"""The corpus pipeline: five of the corpus operators in a row over whole documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's input.  All but the last return the columns of ``documents``.

Defined cases, as in the operators: a document without text fails the base rule and goes at the first stage; an empty
table passes through empty; repeated rows stay repeated until near copies go by id; extra columns, whatever their names,
are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import _shared, bpe, decontaminate, line_dedup, near_dedup, quality_rules
from cardloom.llm.queries import PATTERN, RANKS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; one of which nothing but blanks is left goes.

    ``n_chars`` follows the text.
    """
    cut = line_dedup.remove_repeats(docs)
    left = cut.where((F.col("removed_lines") == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    The verdict is one of ids: rows that repeat an id share it, and a document without an id stays.
    """
    (gone,) = _shared.unused(docs, "_gone")
    verdict = near_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(verdict, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document that is left, and their decoding, as digests."""
    return bpe.digest_documents(docs, RANKS, PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: The boosted trees, the rolling hashes and the merges have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
