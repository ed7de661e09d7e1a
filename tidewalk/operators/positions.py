"""Position rules. Those with memory run as one pass over each series; a series is one group."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAILY, Params


def _scan(rows: DataFrame, keys: list[str], order: str, inputs: list[str], out: str, step: Callable[..., np.ndarray]) -> DataFrame:
    """`rows` with the column `out`, made by `step` from the arrays of `inputs` of each series in order."""
    fields = [f for f in rows.schema.fields if f.name != out]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable", ignore_index=True)
        group[out] = step(*(group[c].to_numpy() for c in inputs))
        return group

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` double"
    return rows.select(*(f.name for f in fields)).groupBy(*keys).applyInPandas(run, kinds)


def hysteresis(z: np.ndarray, broken: np.ndarray, entry: float, exit_: float, stop: float) -> np.ndarray:
    """Short above +entry, long below -entry, out within exit_. A stop or a break bars re-entry until z is back within exit_."""
    state, barred = 0.0, False
    out = np.zeros(len(z))
    for i, (value, bad) in enumerate(zip(z.astype(float), broken.astype(bool), strict=True)):
        size = abs(value)
        if math.isnan(value):
            state = 0.0
        elif bad or (state and size >= stop):
            state, barred = 0.0, True
        elif state:
            state = 0.0 if size <= exit_ else state
        elif barred:
            barred = size > exit_
        elif size >= entry:
            state = -math.copysign(1.0, value)
        out[i] = state
    return out


def pair_positions(rows: DataFrame, keys: list[str], p: Params = DAILY, order: str = "date") -> DataFrame:
    """Rows (keys, order, z, broken) with `pos`; series start flat, so each fold does."""
    rows = rows.withColumn("broken", F.coalesce("broken", F.lit(False))) if "broken" in rows.columns else rows.withColumn("broken", F.lit(False))
    return _scan(rows, keys, order, ["z", "broken"], "pos", lambda z, b: hysteresis(z, b, p.entry, p.exit_, p.stop))


def bands(s: np.ndarray, tradable: np.ndarray, present: np.ndarray, p: Params) -> np.ndarray:
    """Open beyond s_open (but not beyond s_max), close a long above s_close_long, a short below s_close_short."""
    out, state = np.zeros(len(s)), 0.0
    far = math.inf if p.s_max is None else p.s_max
    for i, (value, can, here) in enumerate(zip(s.astype(float), tradable.astype(bool), present.astype(bool), strict=True)):
        if not here or not can:
            state = 0.0
        elif state == 0.0:
            state = -math.copysign(1.0, value) if p.s_open < abs(value) < far else 0.0
        elif (state > 0 and value > p.s_close_long) or (state < 0 and value < p.s_close_short):
            state = 0.0
        out[i] = state
    return out


def band_positions(rows: DataFrame, p: Params = DAILY, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows (keys, date, s_score, tradable, present) of all processed dates with `pos`; absence resets the state."""
    return _scan(rows, list(keys), "date", ["s_score", "tradable", "present"], "pos", lambda s, t, h: bands(s, t, h, p))


def soft_threshold(goal: np.ndarray, band: np.ndarray, tradable: np.ndarray) -> np.ndarray:
    """Move towards the goal by what exceeds the band; out at once when not tradable."""
    out, held = np.zeros(len(goal)), 0.0
    for i, (to, room, can) in enumerate(zip(goal.astype(float), band.astype(float), tradable.astype(bool), strict=True)):
        gap = (0.0 if math.isnan(to) else to) - held
        held = held + math.copysign(max(abs(gap) - room, 0.0), gap) if can and not math.isnan(room) else held * can
        out[i] = held
    return out


def optimal_positions(rows: DataFrame, p: Params = DAILY, keys: tuple[str, ...] = ("symbol",), mu: str | None = None) -> DataFrame:
    """Rows (keys, date, s_score, b, sigma_eq, sigma_step, tradable) with `pos`, the cost-aware optimum.

    The expected return is the fitted reversion, or the column `mu`, summed over the life of the position.
    """
    step = F.col(mu) if mu else -(1 - F.col("b")) * F.col("sigma_eq") * F.col("s_score")
    total = step / F.least(F.greatest(1 - F.col("b"), F.lit(1e-3)), F.lit(1.0))
    risk = F.when(F.col("sigma_step") > 0, p.risk_aversion * F.col("sigma_step") * F.col("sigma_step"))
    rows = rows.withColumn("goal", F.coalesce(total / risk, F.lit(0.0))).withColumn("band", p.opt_cost_bps / 1e4 / risk)
    return _scan(rows, list(keys), "date", ["goal", "band", "tradable"], "pos", soft_threshold)


def quantile_positions(rows: DataFrame, signal: str, p: Params = DAILY, least: int = 20, compat: bool = False) -> DataFrame:
    """Rows with `pos`: the highest fraction of each date long, the lowest short, equal weights.

    With `compat`, untradable names count as lowest before they are dropped, which leaves the short side short of names.
    """
    known = F.col(signal).isNotNull() & F.col("tradable")
    day = Window.partitionBy("date")
    n = F.count_if(known).over(day)
    k = F.greatest(F.bround(p.quantile * n), F.lit(1))
    value = F.when(known, F.col(signal))
    low = F.row_number().over(day.orderBy(value.asc_nulls_first() if compat else value.asc_nulls_last(), "symbol"))
    high = F.row_number().over(day.orderBy(value.desc_nulls_last(), F.desc("symbol")))
    pos = F.when(~known | (n < least), 0.0).when(low <= k, -1.0).when(high <= k, 1.0).otherwise(0.0)
    return rows.withColumn("pos", pos)


#: Edges of the 15 score bins.
EDGES = (-2.5, -2.0, -1.6, -1.3, -1.0, -0.6, -0.2, 0.2, 0.6, 1.0, 1.3, 1.6, 2.0, 2.5)


def score_bin(s: Column) -> Column:
    """Bin 0 to 14, closed on the left; null scores have none."""
    return F.when(s.isNotNull(), sum(((s >= e).cast("int") for e in EDGES[1:]), (s >= EDGES[0]).cast("int")))


def empirical_mu(scores: DataFrame, p: Params = DAILY) -> DataFrame:
    """Rows (date, t, symbol, s_score, r_next) with `mu`: the shrunk mean of later returns in the score's bin.

    t numbers the processed dates. A return enters the date after its score; tables are refitted every mu_refit dates after
    the warm-up, and a bin with too few observations stays 0.
    """
    binned = scores.withColumn("bin", score_bin(F.col("s_score")))
    seen = binned.where("bin IS NOT NULL AND r_next IS NOT NULL").groupBy("bin", (F.col("t") + 1).alias("t")).agg(F.count("*").alias("n"), F.sum("r_next").alias("r"))
    refits = scores.select("t").distinct().where((F.col("t") % p.mu_refit == 0) & (F.col("t") >= p.mu_warmup))
    grid = refits.join(F.broadcast(scores.sparkSession.range(len(EDGES) + 1).select(F.col("id").cast("int").alias("bin"))))
    both = seen.unionByName(grid.select("bin", "t", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("r")))
    upto = Window.partitionBy("bin").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    fitted = both.withColumn("n", F.sum("n").over(upto)).withColumn("r", F.sum("r").over(upto)).join(refits, "t", "left_semi").dropDuplicates(["bin", "t"])
    table = fitted.select("bin", "t", F.when(F.col("n") >= p.mu_min_count, p.mu_shrink * F.col("r") / F.col("n")).otherwise(0.0).alias("mu"))
    asof = F.floor(F.col("t") / p.mu_refit) * p.mu_refit
    keyed = binned.withColumn("refit", F.when(asof >= p.mu_warmup, asof))
    return keyed.join(F.broadcast(table.withColumnRenamed("t", "refit")), ["bin", "refit"], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0))).drop("bin", "refit")


def inverse_risk(rows: DataFrame, sigma: str = "sigma_step") -> DataFrame:
    return rows.withColumn("sized", F.when(F.col(sigma) > 0, F.col("pos") / F.col(sigma)).otherwise(0.0))


def external_signal(rows: DataFrame, signal: str) -> DataFrame:
    """Rows with s_score replaced by the negated cross-sectional z of another signal."""
    day = Window.partitionBy("date")
    sd = F.stddev_pop(signal).over(day)
    return rows.withColumn("s_score", F.when(sd > 0, -(F.col(signal) - F.avg(signal).over(day)) / sd))


def external_mu(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with `mu` from a (date, symbol, mu) table, 0 where it has none."""
    return rows.join(table.select("date", "symbol", "mu"), ["date", "symbol"], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))


def book_weights(positions: DataFrame, loadings: DataFrame, normalise: bool = True, pos: str = "sized") -> DataFrame:
    """date, symbol, w: positions less the factor portfolios that hedge them, netted over the book.

    positions (date, symbol, pos); loadings (date, symbol, factor, beta, q). Two contractions, by factor and by name.
    """
    gross = F.sum(F.abs(pos)).over(Window.partitionBy("date"))
    p = F.when(gross > 0, F.col(pos) / gross).otherwise(0.0) if normalise else F.col(pos)
    held = positions.withColumn("p", p).select("date", "symbol", "p")
    exposure = held.join(loadings, ["date", "symbol"]).groupBy("date", "factor").agg(F.sum(F.col("p") * F.col("beta")).alias("f"))
    hedge = loadings.join(exposure, ["date", "factor"]).groupBy("date", "symbol").agg(F.sum(F.col("q") * F.col("f")).alias("h"))
    return held.join(hedge, ["date", "symbol"], "left").select("date", "symbol", (F.col("p") - F.coalesce("h", F.lit(0.0))).alias("w"))


def held_weights(goal: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Keep the weight before while the change is smaller than the day's band."""
    out, held = np.zeros(len(goal)), 0.0
    for i, (to, band) in enumerate(zip(goal.astype(float), least.astype(float), strict=True)):
        held = held if abs(to - held) < band else to
        out[i] = held
    return out


def no_trade_band(weights: DataFrame, band: float, n_symbols: int) -> DataFrame:
    """Rows (date, symbol, w) of all processed dates x symbols with `held`; the band is a share of the day's mean |w|."""
    day = F.sum(F.abs("w")).over(Window.partitionBy("date")) / F.lit(n_symbols)
    return _scan(weights.withColumn("least", band * day), ["symbol"], "date", ["w", "least"], "held", held_weights)
