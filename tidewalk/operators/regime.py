"""Causal regime statistics and flags of a pair: all use only rows up to the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAILY, Params
from .pairs import engle_granger, half_life


def numbered(series: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """Rows numbered from 0 within their series."""
    return series.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def trailing(rows: DataFrame, keys: list[str], window: int, step: int) -> DataFrame:
    """Each row in every window [at - window, at) that is evaluated at a multiple of `step` from `window` on.

    A row is copied to at most window / step evaluation points by arithmetic on its number, not by a range join.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("i") + 1 - window) / step))
    last = F.floor(F.col("i") / step)
    at = F.explode(F.sequence(first, last)) if window > 0 else F.lit(0)
    return rows.withColumn("k", at).withColumn("at", (F.lit(window) + F.col("k") * step).cast("int")).drop("k")


def filled_at(rows: DataFrame, points: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with the value of the last evaluation point at or before them (nulls are passed over)."""
    joined = rows.join(points.withColumnRenamed("at", "i"), [*keys, "i"], "left")
    over = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(column, F.last(column, ignorenulls=True).over(over))


def rolling_pvalue(rows: DataFrame, keys: list[str], window: int = 250, step: int = 21) -> DataFrame:
    """Rows (keys, i, la, lb) with `coint_p`: the test over the window before the last evaluation point."""
    inside = trailing(rows.where("la IS NOT NULL AND lb IS NOT NULL"), keys, window, step)
    tested = engle_granger(inside, [*keys, "at"], "i").where(F.col("n_obs") >= 0.8 * window)
    return filled_at(rows, tested.select(*keys, "at", F.col("pvalue").alias("coint_p")), keys, "coint_p")


def rolling_half_life(rows: DataFrame, keys: list[str], window: int = 250, step: int = 21, value: str = "s") -> DataFrame:
    found = half_life(trailing(rows, keys, window, step), [*keys, "at"], "i", value)
    return filled_at(rows, found.select(*keys, "at", F.col("half_life").alias("roll_hl")), keys, "roll_hl")


def rolling_beta(keys: list[str], window: int, order: str = "i") -> Column:
    """Slope of la on lb over the last `window` rows, the current one included; null until all are known."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    both = F.col("la").isNotNull() & F.col("lb").isNotNull()
    cov, var = F.covar_samp("la", "lb").over(over), F.var_samp(F.when(both, F.col("lb"))).over(over)
    return F.when((F.count_if(both).over(over) == window) & (var > 0), cov / F.when(var > 0, var))


def since_mean_cross(rows: DataFrame, keys: list[str], band: float = 0.5, order: str = "i") -> DataFrame:
    """Rows with `stale`: rows since |z| was last within the band; before any, since the first row."""
    inside = F.coalesce(F.abs("z") <= band, F.lit(False))
    island = F.sum(inside.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("_island", island)
    return grouped.withColumn("stale", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(order)) - 1).drop("_island")


def regime_flags(rows: DataFrame, keys: list[str], p: Params = DAILY) -> DataFrame:
    """Rows (keys, date, la, lb, s, z, beta) with p_break, beta_break, hl_break, stale_break and broken."""
    rows = numbered(rows, keys)
    rows = rolling_half_life(rolling_pvalue(rows, keys, p.regime_window, p.regime_step), keys, p.regime_window, p.regime_step)
    rows = since_mean_cross(rows.withColumn("roll_beta", rolling_beta(keys, p.regime_window)), keys, p.mean_band)
    drift = F.abs(F.col("roll_beta") - F.col("beta")) / F.greatest(F.abs("beta"), F.lit(1e-8))
    tests = {"p_break": F.col("coint_p") > p.p_max, "beta_break": drift > p.beta_drift_max, "hl_break": F.col("roll_hl") > p.regime_half_life_max, "stale_break": F.col("stale") > p.stale_max}
    for name, test in tests.items():
        rows = rows.withColumn(name, F.coalesce(test, F.lit(False)))
    return rows.withColumn("broken", F.expr(" OR ".join(tests)))
