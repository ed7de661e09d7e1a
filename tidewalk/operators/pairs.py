"""Pair estimators as grouped and windowed aggregates; `keys` name the group of one series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import mackinnon_p
from ..params import DAILY, Params

PAIR = ["fold", "a", "b"]


def pair_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., a, b, date, la, lb: all pairs a < b of symbols on the dates both have.

    The self-join is on the date (and `by`), so its tasks hold sessions, not whole series.
    """
    keys = [*by, "date"]
    left = rows.select(*keys, F.col("symbol").alias("a"), F.col("log_px").alias("la")).where("la IS NOT NULL")
    right = rows.select(*keys, F.col("symbol").alias("b"), F.col("log_px").alias("lb")).where("lb IS NOT NULL")
    return left.join(right, keys).where("a < b")


def hedge_ols(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.regr_slope("la", "lb").alias("beta"), F.regr_intercept("la", "lb").alias("alpha"), F.count("*").alias("n_obs"))


def hedge_tls(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of the first principal axis of (lb, la); null without covariance."""
    m = pairs.groupBy(*keys).agg(F.var_samp("la").alias("yy"), F.var_samp("lb").alias("xx"), F.covar_samp("la", "lb").alias("xy"), F.avg("la").alias("ma"), F.avg("lb").alias("mb"))
    d = F.col("yy") - F.col("xx")
    beta = F.try_divide(d + F.sqrt(d * d + 4 * F.col("xy") * F.col("xy")), 2 * F.col("xy"))
    return m.withColumn("beta", beta).withColumn("alpha", F.col("ma") - F.col("beta") * F.col("mb")).select(*keys, "beta", "alpha")


def spread(beta: str = "beta", alpha: str = "alpha") -> Column:
    return F.col("la") - F.col(beta) * F.col("lb") - F.col(alpha)


def _steps(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each value with the last known one before it: x (before) and dx, gaps skipped."""
    before = Window.partitionBy(*keys).orderBy(order)
    known = series.where(F.col(value).isNotNull())
    return known.withColumn("x", F.lag(value).over(before)).withColumn("dx", F.col(value) - F.col("x")).where("x IS NOT NULL")


def half_life(series: DataFrame, keys: list[str], order: str = "date", value: str = "s") -> DataFrame:
    """keys..., n, half_life: -ln 2 / ln(1 + b) of the regression of steps on levels; null unless mean-reverting."""
    fit = _steps(series, keys, order, value).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("dx", "x").alias("_slope"))
    phi = 1 + F.col("_slope")
    return fit.select(*keys, F.col("n"), F.when((F.col("n") >= 19) & (phi > 0) & (phi < 1), -math.log(2) / F.ln(phi)).alias("half_life"))


def ou_params(series: DataFrame, keys: list[str], dt: float = 1.0, order: str = "date", value: str = "s") -> DataFrame:
    """keys..., theta, mu, sigma, half_life of an Ornstein-Uhlenbeck process sampled every dt."""
    fit = _steps(series, keys, order, value).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("dx", "x").alias("_slope"), F.regr_intercept("dx", "x").alias("_level"), F.regr_syy("dx", "x").alias("yy"), F.regr_sxy("dx", "x").alias("xy")
    )
    phi = 1 + F.col("_slope")
    rss = F.greatest(F.col("yy") - F.col("_slope") * F.col("xy"), F.lit(0.0))
    ok = (F.col("n") >= 19) & (phi > 0) & (phi < 1)
    theta = -F.ln(phi) / dt
    return fit.select(
        *keys, F.when(ok, theta).alias("theta"), F.when(ok, -F.col("_level") / F.col("_slope")).alias("mu"), F.when(ok, F.sqrt(rss / (F.col("n") - 2)) / math.sqrt(dt)).alias("sigma"), F.when(ok, math.log(2) / theta).alias("half_life")
    )


def with_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pair rows with beta, alpha, n_obs and the residual s, in one shuffle by the pair."""
    whole = Window.partitionBy(*keys)
    fitted = pairs.withColumn("beta", F.regr_slope("la", "lb").over(whole)).withColumn("alpha", F.regr_intercept("la", "lb").over(whole)).withColumn("n_obs", F.count("*").over(whole))
    return fitted.withColumn("s", spread())


def engle_granger(pairs: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """keys..., beta, alpha, n_obs, pvalue, tstat, half_life, resid_std of the two-step test with one lag, no constant.

    The second regression is closed form in six sums, so a pair needs one shuffle and no solver.
    """
    before = Window.partitionBy(*keys).orderBy(order)
    r = with_fit(pairs, keys).withColumn("u", F.lag("s").over(before)).withColumn("w", F.lag("s", 2).over(before))
    r = r.withColumn("y", F.col("s") - F.col("u")).withColumn("v", F.col("u") - F.col("w"))
    lagged = F.col("v").isNotNull()
    prod = lambda x, y: F.sum(F.when(lagged, F.col(x) * F.col(y)))
    m = r.groupBy(*keys).agg(
        F.first("beta").alias("beta"), F.first("alpha").alias("alpha"), F.count("*").alias("n_obs"), F.count_if(lagged).alias("m"), F.var_samp("s").alias("resid_var"),
        *(prod(x, y).alias(f"{x}{y}") for x, y in ("uu", "vv", "uv", "uy", "vy", "yy")), F.regr_slope("y", "u").alias("_slope"), F.count("y").alias("n_steps"),
    )
    c = F.col
    det = c("uu") * c("vv") - c("uv") * c("uv")
    gamma = F.try_divide(c("vv") * c("uy") - c("uv") * c("vy"), det)
    delta = F.try_divide(c("uu") * c("vy") - c("uv") * c("uy"), det)
    rss = c("yy") - gamma * c("uy") - delta * c("vy")
    t = gamma / F.sqrt(rss / (c("m") - 2) * c("vv") / det)
    phi = 1 + c("_slope")
    life = F.when((c("n_steps") >= 19) & (phi > 0) & (phi < 1), -math.log(2) / F.ln(phi))
    spare = F.when(c("n_obs") > 2, c("n_obs") - 2)  # the fit takes two degrees of freedom
    m = m.withColumn("resid_std", F.sqrt(c("resid_var") * (c("n_obs") - 1) / spare))
    out = m.withColumn("tstat", F.when((det > 0) & (rss > 0) & (c("m") > 2), t))
    return out.select(*keys, "beta", "alpha", "n_obs", F.when(c("tstat").isNull(), 0.0).otherwise(mackinnon_p(c("tstat"))).alias("pvalue"), "tstat", life.alias("half_life"), "resid_std")


def passes_quality(p: Params = DAILY) -> Column:
    known = F.col("half_life").isNotNull() & F.col("beta").isNotNull()
    return F.coalesce(known & F.col("half_life").between(p.half_life_min, p.half_life_max) & F.col("beta").between(p.beta_min, p.beta_max) & (F.col("n_obs") >= p.min_obs), F.lit(False))


def fold_rows(rets: DataFrame, folds: DataFrame, lo: str, hi: str, members: DataFrame | None = None) -> DataFrame:
    """The panel's rows inside each fold's window (lo, hi), of each fold's members if given."""
    parts = folds.select("fold", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    rows = rets.join(F.broadcast(parts), F.col("date").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return rows if members is None else rows.join(members.select("fold", "symbol"), ["fold", "symbol"], "left_semi")


def screen(rets: DataFrame, folds: DataFrame, p: Params = DAILY, members: DataFrame | None = None) -> DataFrame:
    """All pairs of each fold tested over its in-sample window, with `quality`; all folds at once."""
    pairs = pair_rows(fold_rows(rets, folds, "is_lo", "is_hi", members), ("fold",))
    tested = engle_granger(pairs, PAIR).join(F.broadcast(folds.select("fold", "n_is")), "fold")
    return tested.where(F.col("n_obs") >= F.floor(0.8 * F.col("n_is"))).drop("n_is").withColumn("quality", passes_quality(p))


def rolling_z(value: str, keys: list[str], order: str, window: int, least: int | None = None) -> Column:
    """Causal z-score over the last `window` rows, the current one included."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp(value).over(over)
    return F.when((F.count(value).over(over) >= (least or window)) & (sd > 0), (F.col(value) - F.avg(value).over(over)) / sd)


def calibrate(series: DataFrame, keys: list[str], value: str = "s") -> DataFrame:
    return series.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))


def frozen_z(value: str = "s", mu: str = "mu", sigma: str = "sigma") -> Column:
    return F.when(F.col(sigma) > 0, (F.col(value) - F.col(mu)) / F.col(sigma))


def concentration(selected: DataFrame) -> DataFrame:
    """symbol, n, share: in how many selected pairs each name stands."""
    names = selected.select(F.explode(F.array("a", "b")).alias("symbol"))
    total = F.broadcast(selected.agg(F.count("*").alias("pairs")))
    return names.groupBy("symbol").agg(F.count("*").alias("n")).join(total).select("symbol", "n", (F.col("n") / F.col("pairs")).alias("share"))


def excess_over_chance(scan: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    found = F.count_if(F.col("pvalue") < alpha)
    out = scan.groupBy(*by).agg(F.count("*").alias("n_tests"), found.alias("found"))
    expected = alpha * F.col("n_tests")
    return out.withColumn("expected", expected).withColumn("excess", F.col("found") - F.col("expected")).withColumn("ratio", F.col("found") / F.col("expected"))
