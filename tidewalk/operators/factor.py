"""Factor residuals and their Ornstein-Uhlenbeck scores: a market model in expressions, and rolling PCA by Arrow kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAILY, Params
from .panel import rolling_eligibility


def marchenko_pastur_count(eigenvalues: DataFrame, keys: list[str], n_obs: int, cap: int = 30) -> DataFrame:
    """keys..., k: eigenvalues (column `value`) above the noise edge of a correlation matrix, between 1 and `cap`."""
    n = F.count("value").over(Window.partitionBy(*keys))
    edge = F.pow(1 + F.sqrt(n / n_obs), F.lit(2.0))
    above = eigenvalues.withColumn("_above", F.col("value") > edge)
    return above.groupBy(*keys).agg(F.least(F.greatest(F.count_if("_above"), F.lit(1)), F.lit(cap)).alias("k"))


def factor_returns(rets: DataFrame, loadings: DataFrame) -> DataFrame:
    """date, factor, f: returns of the portfolios q."""
    return rets.join(loadings, ["date", "symbol"]).groupBy("date", "factor").agg(F.sum(F.col("ret") * F.col("q")).alias("f"))


def market_factor(rets: DataFrame) -> DataFrame:
    return rets.groupBy("date", "didx").agg(F.avg("ret").alias("f"))


def window_residuals(rets: DataFrame, factor: DataFrame, window: int) -> DataFrame:
    """symbol, t, didx, resid, beta, alpha: residuals of each trailing window's own regression on one factor.

    A row is copied to the `window` evaluation dates it belongs to by arithmetic; windows with a gap are left out.
    """
    joined = rets.where("ret IS NOT NULL").join(F.broadcast(factor.select("didx", "f")), "didx").select("symbol", "didx", "ret", "f")  # a row a session
    copied = joined.withColumn("t", F.explode(F.sequence(F.col("didx"), F.col("didx") + window - 1)))
    whole = Window.partitionBy("symbol", "t")
    fitted = copied.withColumn("beta", F.regr_slope("ret", "f").over(whole)).withColumn("alpha", F.regr_intercept("ret", "f").over(whole))
    fitted = fitted.withColumn("_n", F.count("*").over(whole)).withColumn("_last", F.max("didx").over(whole)).where((F.col("_n") == window) & (F.col("_last") == F.col("t")))
    return fitted.select("symbol", "t", "didx", (F.col("ret") - F.col("alpha") - F.col("beta") * F.col("f")).alias("resid"), "beta", "alpha")


def ou_scores(residuals: DataFrame, per_year: int = 252) -> DataFrame:
    """symbol, t, s_score, kappa, m, sigma_eq, b, sigma_step of the cumulative residual of each window."""
    order = Window.partitionBy("symbol", "t").orderBy("didx")
    x = residuals.withColumn("x1", F.sum("resid").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("x0", F.lag("x1").over(order))
    m = x.groupBy("symbol", "t").agg(
        F.max_by("x1", "didx").alias("last"), F.count("x0").alias("n"),
        *(f("x1", "x0").alias(k) for k, f in (("b", F.regr_slope), ("a", F.regr_intercept), ("yy", F.regr_syy), ("xy", F.regr_sxy))),
    )
    return m.select("symbol", "t", *_ou_columns(per_year))


def _ou_columns(per_year: int) -> list[Column]:
    b, ok = F.col("b"), F.col("b").between(0, 1) & (F.col("b") > 0) & (F.col("b") < 1)
    zeta = F.greatest(F.col("yy") - b * F.col("xy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))
    level = F.when(ok, F.col("a") / F.when(ok, 1 - b))
    spread = F.when(ok, F.sqrt(zeta / F.when(ok, 1 - b * b)))
    return [
        F.when(spread > 0, (F.col("last") - level) / spread).alias("s_score"),
        F.when(ok, -F.ln(F.when(ok, b)) * per_year).alias("kappa"),
        level.alias("m"),
        spread.alias("sigma_eq"),
        b.alias("b"),
        F.sqrt(zeta).alias("sigma_step"),
    ]


def tradable(p: Params = DAILY, per_year_of_kappa: int = 252) -> Column:
    """Finite score and a half-life, in days of the given calendar, that is short enough."""
    days = math.log(2) / F.col("kappa") * p.periods_per_year
    return F.coalesce(F.col("s_score").isNotNull() & (days <= p.half_life_days), F.lit(False))


PERCENTILES = (0.0, 0.02, 0.05, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90, 0.95, 0.98, 1.0)


def signal_shape(scores: DataFrame, least: int = 200) -> DataFrame:
    """bin, n, mean_s, mean_bp, t_stat of the next residual (r_next) by percentile bins of the score."""
    known = scores.where("s_score IS NOT NULL AND r_next IS NOT NULL")
    cuts = F.broadcast(known.agg(F.percentile("s_score", F.array(*map(F.lit, PERCENTILES))).alias("cuts")))  # one row
    binned = known.join(cuts).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("s_score"))) - 1)
    out = binned.where(f"bin < {len(PERCENTILES) - 1}").groupBy("bin").agg(F.count("*").alias("n"), F.avg("s_score").alias("mean_s"), F.avg("r_next").alias("_m"), F.stddev_samp("r_next").alias("_sd"))
    return out.where(F.col("n") >= least).select("bin", "n", "mean_s", (1e4 * F.col("_m")).alias("mean_bp"), (F.col("_m") / (F.col("_sd") / F.sqrt("n"))).alias("t_stat"))


# ---- rolling PCA


def processed(rets: DataFrame, members: DataFrame | None, p: Params = DAILY) -> DataFrame:
    """t, date, symbol, adv, i, refresh, fitted: the names of each date that is worked on, the date of its factors, and
    that of its betas.

    Factors are renewed every pca_step sessions, betas every beta_step, and both whenever the list of names differs
    from the date before, so the renewal dates are a window over dates, not a loop.
    """
    start = max(p.pca_window, p.reg_window) + 1
    rows = rolling_eligibility(rets, p.pca_window, p.factor_min_adv).where("eligible").select("date", F.col("didx").alias("t"), "symbol", "adv")
    last = F.broadcast(rets.agg(F.max("didx").alias("_last")))
    rows = rows.join(last).where((F.col("t") >= start) & (F.col("t") < F.col("_last"))).drop("_last")
    if members is not None:
        rows = rows.join(members.select("date", "symbol"), ["date", "symbol"], "left_semi")
    dates = rows.groupBy("t").agg(F.count("*").alias("n"), F.xxhash64(F.sort_array(F.collect_list("symbol"))).alias("names")).where(F.col("n") >= p.min_names)
    order = Window.orderBy("t")  # a row a session
    other = F.coalesce(F.lag("names").over(order) != F.col("names"), F.lit(True))
    for name, step in (("refresh", p.pca_step), ("fitted", p.beta_step)):
        renewed = F.when(other | ((F.col("t") - start) % step == 0), F.col("t"))
        dates = dates.withColumn(name, F.last(renewed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(F.broadcast(dates.select("t", "refresh", "fitted")), "t").withColumn("i", F.col("t") - start)


def _chunked(targets: DataFrame, rets: DataFrame, at: str, window: int, size: int, ahead: int = 0) -> tuple[DataFrame, DataFrame]:
    """Targets by chunks of dates, and the return rows that their windows reach, each copied to few chunks.

    ahead: sessions after `at` that are read too.
    """
    own = targets.withColumn("chunk", F.floor(F.col(at) / size))
    chunks = F.explode(F.sequence(F.floor((F.col("didx") - ahead) / size), F.floor((F.col("didx") + window - 1) / size)))
    reach = rets.where("ret IS NOT NULL").select(F.col("symbol").alias("name"), F.col("didx").alias("day"), F.col("ret").alias("r"), chunks.alias("part"))
    return own, reach


def _windows(returns: pd.DataFrame) -> tuple[np.ndarray, dict[int, int], dict[str, int]]:
    dates, names = np.unique(returns["day"]), np.unique(returns["name"].astype(str))
    wide = np.full((len(dates), len(names)), np.nan)
    wide[np.searchsorted(dates, returns["day"]), np.searchsorted(names, returns["name"].astype(str))] = returns["r"]
    return wide, {int(d): i for i, d in enumerate(dates)}, {s: i for i, s in enumerate(names)}


def eigen_portfolios(window: np.ndarray, n_factors: int | str, cap: int = 30) -> np.ndarray:
    """Leading eigenvectors of the correlation matrix, divided by volatility; their largest entry is positive."""
    sd = window.std(axis=0, ddof=1)
    z = (window - window.mean(axis=0)) / np.where(sd > 0, sd, np.nan)
    corr = np.nan_to_num(z.T @ z / (len(window) - 1), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    values, vectors = np.linalg.eigh(corr)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = n_factors if n_factors != "mp" else int(np.clip((values > (1 + math.sqrt(len(sd) / len(window))) ** 2).sum(), 1, cap))
    v = vectors[:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return np.where(sd[:, None] > 0, v / np.where(sd > 0, sd, 1)[:, None], 0.0)


def loadings(names: DataFrame, rets: DataFrame, p: Params = DAILY, n_factors: int | str | None = None) -> DataFrame:
    """refresh, symbol, q (array): eigenportfolios of every renewal date, a chunk of dates a task."""
    k = n_factors or p.n_factors
    targets = names.where("t = refresh").select("t", "symbol")
    own, reach = _chunked(targets, rets, "t", p.pca_window, p.pca_window)

    def run(targets: pd.DataFrame, returns: pd.DataFrame) -> pd.DataFrame:
        wide, row, column = _windows(returns)
        out = []
        for t, group in targets.groupby("t"):
            symbols = sorted(group.symbol)
            q = eigen_portfolios(wide[row[t] - p.pca_window + 1 : row[t] + 1][:, [column[s] for s in symbols]], k)
            out.append(pd.DataFrame({"refresh": t, "symbol": symbols, "q": list(q)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["refresh", "symbol", "q"])

    return own.groupBy("chunk").cogroup(reach.groupBy("part")).applyInPandas(run, "refresh long, symbol string, q array<double>")


def pca_scores(names: DataFrame, rets: DataFrame, q: DataFrame, p: Params = DAILY) -> DataFrame:
    """t, symbol, q, beta (intercept first), s_score, kappa, m, sigma_eq, b, sigma_step, resid_sd, resid (array).

    Between its fit dates a date's residuals are those of the last fit's betas on its own window.
    """
    targets = names.select("t", "symbol", "refresh", "fitted").join(q, ["refresh", "symbol"])
    own, reach = _chunked(targets, rets, "fitted", p.reg_window, p.pca_window, p.beta_step - 1)

    def run(targets: pd.DataFrame, returns: pd.DataFrame) -> pd.DataFrame:
        wide, row, column = _windows(returns)
        out, fits = [], {}
        for t, group in targets.groupby("t"):  # in the order of dates: a fit before those that use it
            group = group.sort_values("symbol")
            r = wide[row[t] - p.reg_window + 1 : row[t] + 1][:, [column[s] for s in group.symbol]]
            weights = np.stack(group.q.to_numpy())
            design = np.column_stack([np.ones(len(r)), r @ weights])
            fitted = int(group.fitted.iloc[0])
            if fitted not in fits:
                fits = {fitted: np.linalg.lstsq(design, r, rcond=None)[0]}
            beta = fits[fitted]
            resid = r - design @ beta
            x = resid.cumsum(axis=0)
            x0, x1 = x[:-1] - x[:-1].mean(0), x[1:] - x[1:].mean(0)
            var = (x0 * x0).sum(0)
            with np.errstate(all="ignore"):
                b = np.where(var > 0, (x0 * x1).sum(0) / var, np.nan)
                zeta = ((x1 - b * x0) ** 2).sum(0) / max(len(x0) - 2, 1)
                ok = (b > 0) & (b < 1)
                m = np.where(ok, (x[1:].mean(0) - b * x[:-1].mean(0)) / (1 - b), np.nan)
                eq = np.where(ok, np.sqrt(zeta / (1 - b * b)), np.nan)
                s = np.where(eq > 0, (x[-1] - m) / eq, np.nan)
                kappa = np.where(ok, -np.log(b) * 252, np.nan)
            out.append(pd.DataFrame({
                "t": t, "symbol": group.symbol.to_numpy(), "q": list(weights), "beta": list(beta.T), "s_score": s, "kappa": kappa, "m": m,
                "sigma_eq": eq, "b": b, "sigma_step": np.sqrt(zeta), "resid_sd": resid.std(axis=0, ddof=1), "resid": list(resid.T),
            }))
        frame = pd.concat(out) if out else pd.DataFrame(columns=["t", "symbol", "q", "beta", "s_score", "kappa", "m", "sigma_eq", "b", "sigma_step", "resid_sd", "resid"])
        return frame

    kinds = "t long, symbol string, q array<double>, beta array<double>, s_score double, kappa double, m double, sigma_eq double, b double, sigma_step double, resid_sd double, resid array<double>"
    found = own.groupBy("chunk").cogroup(reach.groupBy("part")).applyInPandas(run, kinds)
    for c in ("s_score", "kappa", "m", "sigma_eq", "b", "sigma_step", "resid_sd"):
        found = found.withColumn(c, F.when(~F.isnan(c), F.col(c)))  # columns hold nulls, never NaN
    return found
