"""The learned signal, on the market model's residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factor, learn
from ..params import WEEKLY
from ..plans import statarb
from ..registry import query
from . import sql as Q
from .factors import COPIED, FITTED, RESID, SCORES, W, rets_of
from .factors import BASE as ROWS
from .pairs import rounded

YS = [f"y{k}" for k in learn.HORIZONS]
ALL = [*learn.FEATURES, *YS]
PANEL = f"""mv AS (SELECT symbol, t, {', '.join(f'sum(resid) FILTER (WHERE t - didx < {k}) AS r{k}' for k in learn.LAGS)},
  stddev_samp(resid) FILTER (WHERE t - didx < 20) / stddev_samp(resid) AS vol_ratio, any_value(beta) AS beta FROM rs GROUP BY symbol, t),
ah AS (SELECT symbol, date, didx AS t, dollar_volume, close / max(close) OVER (PARTITION BY symbol ORDER BY didx RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) - 1 AS drawdown,
  {', '.join(f'CASE WHEN count(ret) OVER h{k} = {k} THEN sum(ret) OVER h{k} END AS a{k}, sum(f) OVER h{k} AS f{k}' for k in learn.HORIZONS)} FROM rets JOIN mkt USING (didx)
  WINDOW {', '.join(f'h{k} AS (PARTITION BY symbol ORDER BY didx RANGE BETWEEN 1 FOLLOWING AND {k} FOLLOWING)' for k in learn.HORIZONS)}),
j1 AS (SELECT sc.*, r1, r2, r5, r10, r20, vol_ratio, beta, date, drawdown, ln(2) / kappa * 52 AS hl, stddev_pop(s_score) OVER (PARTITION BY t) AS disp,
  percent_rank() OVER (PARTITION BY t ORDER BY dollar_volume, symbol) AS adv_rank,
  {', '.join(f'(a{k} - beta * f{k}) / CASE WHEN sigma_step > 0 THEN sigma_step * sqrt({k}.0) END AS y{k}' for k in learn.HORIZONS)} FROM sc JOIN mv USING (symbol, t) JOIN ah USING (symbol, t)),
kn AS (SELECT * FROM j1 WHERE hl > 0 AND hl <= 60 AND {' AND '.join(f'{c} IS NOT NULL' for c in [*ALL, 'sigma_step'])}),
ml AS (SELECT date, symbol, t, {', '.join(ALL)}, sigma_step FROM kn QUALIFY count(*) OVER (PARTITION BY t) >= 10)"""
ML = (*ROWS, COPIED, FITTED, RESID, SCORES, PANEL)


def panel_of(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    market = factor.market_factor(rets)
    resid = factor.window_residuals(rets, market, W)
    return learn.features(factor.ou_scores(resid), resid, rets, market, W, WEEKLY.periods_per_year, 60.0, 10)


@query("l1_feature_panel", *ML, f"SELECT date, symbol, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ALL)} FROM ml")
def l1(spark, sf_dir):
    return rounded(panel_of(spark, sf_dir).select("date", "symbol", *ALL), *ALL, digits=4)


@query(
    "l2_permutation_null", *ML,
    "pa AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY symbol) AS k FROM ml)",
    "pb AS (SELECT date, y1, row_number() OVER (PARTITION BY date ORDER BY md5(symbol || strftime(date, '%Y%m%d') || '/5'), symbol) AS k FROM ml)",
    "SELECT pa.date, pa.symbol, round(pb.y1, 4) + 0.0 AS y1 FROM pa JOIN pb USING (date, k)",
)
def l2(spark, sf_dir):
    return rounded(learn.permuted(panel_of(spark, sf_dir), "y1", 5).select("date", "symbol", "y1"), "y1", digits=4)


SPLIT = """yr AS (SELECT ml.*, test_year FROM ml JOIN (SELECT CAST(unnest(range(1998, 2002)) AS INTEGER) AS test_year) ON year(date) <= test_year),
ct AS (SELECT test_year, quantile_cont(CAST(epoch(date) AS DOUBLE), 0.8) AS cut FROM yr WHERE year(date) < test_year GROUP BY test_year HAVING count(*) >= 200),
sp AS (SELECT yr.*, CASE WHEN year(date) = test_year THEN 'test' WHEN CAST(epoch(date) AS DOUBLE) <= cut THEN 'train' ELSE 'val' END AS part FROM yr JOIN ct USING (test_year))"""


def split_of(spark, sf_dir):
    return learn.splits(panel_of(spark, sf_dir), 1998, 2001, least=200)


@query("l3_walk_forward_splits", *ML, SPLIT, "SELECT test_year, part, count(*) AS n, min(date) AS first, max(date) AS last FROM sp GROUP BY ALL")
def l3(spark, sf_dir):
    return split_of(spark, sf_dir).groupBy("test_year", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "l4_standardised", *ML, SPLIT,
    "st AS (SELECT test_year, avg(r5) FILTER (WHERE part = 'train') AS m, stddev_samp(r5) FILTER (WHERE part = 'train') AS s FROM sp GROUP BY test_year)",
    "SELECT test_year, date, symbol, round((r5 - m) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END, 4) + 0.0 AS r5 FROM sp JOIN st USING (test_year)",
)
def l4(spark, sf_dir):
    return rounded(learn.standardised(split_of(spark, sf_dir), ["r5"]).select("test_year", "date", "symbol", "r5"), "r5", digits=4)


def predictions(spark, sf_dir):
    return learn.network(learn.standardised(split_of(spark, sf_dir), learn.FEATURES), learn.FEATURES, "y1")


@query("l5_network")
def l5(spark, sf_dir):
    return rounded(predictions(spark, sf_dir), "pred", digits=4)


@query("l5b_ridge")
def l5b(spark, sf_dir):
    return rounded(learn.ridge(learn.standardised(split_of(spark, sf_dir), learn.FEATURES), learn.FEATURES, "y1"), "pred", digits=4)


@query("l6_seed_average", *ML, "SELECT date, symbol, round((r1 + r2 + r5) / 3, 5) + 0.0 AS pred FROM ml")
def l6(spark, sf_dir):
    rows = panel_of(spark, sf_dir).select("date", "symbol", F.explode(F.array("r1", "r2", "r5")).alias("pred"))
    return rounded(learn.seed_average(rows), "pred", digits=5)


@query(
    "l7_information_coefficient", *ML,
    "dy AS (SELECT date, corr(s_score, y1) AS ic FROM ml GROUP BY date HAVING count(*) > 5)",
    "SELECT count(*) AS days, round(avg(ic), 5) AS mean, round(stddev_samp(ic), 5) AS sd, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 4) AS t_stat FROM dy",
)
def l7(spark, sf_dir):
    return rounded(rounded(learn.information_coefficient(panel_of(spark, sf_dir), "s_score", "y1"), "mean", "sd", digits=5), "t_stat", digits=4)


@query(
    "l8_smoothed_signal", Q.PANEL, Q.CALENDAR, Q.RETS,
    """SELECT x.symbol, x.date, round(sum(pow(0.5, x.didx - y.didx) * y.ret) / sum(pow(0.5, x.didx - y.didx)), 6) + 0.0 AS smooth FROM rets x LEFT JOIN rets y
    ON y.symbol = x.symbol AND y.didx BETWEEN x.didx - 63 AND x.didx AND y.ret IS NOT NULL GROUP BY x.symbol, x.date""",
)
def l8(spark, sf_dir):
    return rounded(rets_of(spark, sf_dir).select("symbol", "date", learn.smoothed("ret", 3).alias("smooth")), "smooth")


@query("w6_learned_book")
def w6(spark, sf_dir):
    """Predictions of the networks, averaged over seeds and smoothed, traded by quantiles."""
    rets = rets_of(spark, sf_dir)
    book = statarb.learned(rets, predictions(spark, sf_dir), WEEKLY, span=3, rule="quantile", risk_scale=True)
    return rounded(book.select("date", "gross", "turnover", "net", "n_pos"), "gross", "turnover", "net", digits=4)
