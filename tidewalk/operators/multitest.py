"""Multiple-testing corrections over the p-values of one family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("naive", "bonferroni", "bh", "by")


def flags(scan: DataFrame, family: list[str], tie: list[str], alpha: float = 0.05) -> DataFrame:
    """The scan with a boolean column for each of METHODS. `family` names the tests corrected together."""
    whole = Window.partitionBy(*family)
    rank = F.row_number().over(whole.orderBy("pvalue", *tie))
    ranked = scan.withColumn("_n", F.count("*").over(whole)).withColumn("_k", rank)
    harmonic = F.sum(1 / F.col("_k")).over(whole)
    ranked = ranked.withColumn("_h", harmonic)

    def step_up(level: Column) -> Column:
        last = F.max(F.when(F.col("pvalue") <= F.col("_k") * level / F.col("_n"), F.col("_k"))).over(whole)
        return F.coalesce(F.col("_k") <= last, F.lit(False))

    out = ranked.select(
        *scan.columns,
        (F.col("pvalue") <= alpha).alias("naive"),
        (F.col("pvalue") <= F.lit(alpha) / F.greatest("_n", F.lit(1))).alias("bonferroni"),
        step_up(F.lit(alpha)).alias("bh"),
        step_up(F.lit(alpha) / F.col("_h")).alias("by"),
    )
    return out


def discoveries(flagged: DataFrame, family: list[str], alpha: float = 0.05) -> DataFrame:
    return flagged.groupBy(*family).agg(F.count("*").alias("n_tests"), *(F.count_if(F.col(m)).alias(f"n_{m}") for m in METHODS)).withColumn("by_chance", alpha * F.col("n_tests"))
