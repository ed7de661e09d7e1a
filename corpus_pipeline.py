"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewalk.llm.common import read, table
from tidewalk.llm.decontaminate import without_benchmark
from tidewalk.llm.language import learnable, without_rejected
from tidewalk.llm.line_dup import drop_recurring_lines
from tidewalk.llm.near_dup import without_near_duplicates
from tidewalk.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected.

    Each row is judged by its own text, so rows with a null or repeated id go or stay alone. Null, empty and
    letterless texts go, and those of any length whose margin is narrow; an exact tie is the narrowest. Null lang
    values are not learned from. An empty table stays empty. Columns are those of `docs`, whatever their names.
    """
    return without_rejected(docs, learnable(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those with no other line go.

    A recurring line stays in the document of smallest id. Rows that repeat an id count as one document and are cut
    alike; rows with a null id are neither counted nor cut. Null and empty texts stay as they are. An empty table
    stays empty. Other columns pass through, whatever their names.
    """
    kept = drop_recurring_lines(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "text"))
    left = kept.where("n_dropped = 0 OR trim(text) <> ''")
    return left.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    All rows that repeat the staying id stay. Rows with a null id and texts without words, null or empty, belong to no
    group and stay. An empty table stays empty. Columns are those of `docs`, whatever their names.
    """
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own text, so rows with a null or repeated id go or stay alone. Null and empty texts and
    items match nothing. An empty table, or benchmark, drops nothing. Columns are those of `docs`, whatever their names.
    """
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences.

    Null and empty texts are the end-of-document id alone; rows with a null or repeated id are packed one by one;
    documents of equal length are taken in the order of their ids. An empty table gives no pieces. Other columns are ignored.
    """
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Compression, sketches, latent search and the tokenizer have no SQL form; tests hold run() against the stages' own checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
