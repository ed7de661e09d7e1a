"""One thin query for each operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder
from .decontaminate import contaminated
from .forest import nearest
from .language import identify, learnable
from .line_dup import LINES_SQL, drop_recurring_lines
from .near_dup import NEAR_SQL, near_duplicates
from .packing import pack_documents
from .quotes import MAIL_SQL, as_mail, chat
from .sharding import SHARD_SQL, shard
from .substring_dup import REPEATS_SQL, without_repeats
from .toxicity import score_toxicity


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learnable(docs)).withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat(as_mail(read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_nearest": op3_nearest,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat": op10_chat,
}

ORACLES: dict[str, str] = {"op1_near_dedup": NEAR_SQL, "op5_sharding": SHARD_SQL, "op8_substring_dedup": REPEATS_SQL, "op9_line_dedup": LINES_SQL, "op10_chat": MAIL_SQL}
