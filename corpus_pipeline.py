"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes what its predecessor kept, in whole, and its decisions take effect: documents that the quality
rules reject go, repeated lines are cut out (a document without a line left goes with them), one document of each
near-duplicate group stays, documents with a benchmark passage go, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlark.llm import decontam, jaccard, lines, packing, quality
from roadlark.llm.common import Scratch, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has no words and goes; repeated rows are judged each for itself; columns stay as they are."""
    return quality.filter_documents(docs, quality.STANDARD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lost lines and have nothing but white space left are copies through and through, and go.

    Null and empty texts have no lines and stay. n_chars, where there is one, is that of the text left.
    """
    cut = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cut.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", n_chars)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; null and empty texts and rows without an id stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is decided by its own text, a null or empty one stays."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces in sequences; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express SimHash, the random walks or the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's rows written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
