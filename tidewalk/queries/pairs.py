"""Pair estimators, corrections, regime statistics and pair positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import multitest, panel, positions, regime
from ..operators import pairs as E
from ..params import WEEKLY
from ..plans import pairs_book
from ..registry import query
from . import sql as Q
from .panels import weekly

KEYS = E.PAIR
BASE = (Q.PANEL, Q.CALENDAR, Q.FOLDS, Q.IS_ROWS, Q.pairs("pr", "is_rows"))
SCAN = (*BASE, Q.engle_granger("tested", "pr"))
QUALITY = """scan AS (SELECT t.*, coalesce(half_life BETWEEN 0.1 AND 30 AND beta BETWEEN 0.02 AND 3.0 AND n_obs >= 100, false) AS quality
  FROM tested t JOIN folds USING (fold) WHERE n_obs >= floor(0.8 * n_is))"""
FLAGS = """ranked AS (SELECT *, count(*) OVER (PARTITION BY fold) AS n, row_number() OVER (PARTITION BY fold ORDER BY pvalue, a, b) AS k FROM scan),
harm AS (SELECT *, sum(1.0 / k) OVER (PARTITION BY fold) AS h FROM ranked),
flags AS (SELECT * EXCLUDE (n, k, h), pvalue <= 0.05 AS naive, pvalue <= 0.05 / greatest(n, 1) AS bonferroni,
  coalesce(k <= max(CASE WHEN pvalue <= k * 0.05 / n THEN k END) OVER (PARTITION BY fold), false) AS bh,
  coalesce(k <= max(CASE WHEN pvalue <= k * (0.05 / h) / n THEN k END) OVER (PARTITION BY fold), false) AS "by" FROM harm)"""


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits) + 0.0)
    return df


def in_sample(spark, sf_dir):
    prices = weekly(spark, sf_dir)
    return E.pair_rows(E.fold_rows(panel.returns(prices), panel.folds(prices, WEEKLY), "is_lo", "is_hi"), ("fold",))


def spreads(spark, sf_dir):
    return E.with_fit(in_sample(spark, sf_dir), KEYS).select(*KEYS, "date", "s")


@query("e1_hedge_ols", *BASE, "SELECT fold, a, b, round(regr_slope(la, lb), 6) + 0.0 AS beta, round(regr_intercept(la, lb), 6) + 0.0 AS alpha, count(*) AS n_obs FROM pr GROUP BY ALL")
def e1(spark, sf_dir):
    return rounded(E.hedge_ols(in_sample(spark, sf_dir), KEYS), "beta", "alpha")


# a nearly flat covariance gives slopes of any size, so slopes are compared by their leading digits
@query(
    "e2_hedge_tls", *BASE,
    """SELECT fold, a, b, format('{:.4e}', beta) AS beta, round(atan(beta), 6) + 0.0 AS angle, round((ma - beta * mb) / sqrt(1 + beta * beta), 6) + 0.0 AS offset_
    FROM (SELECT fold, a, b, avg(la) AS ma, avg(lb) AS mb,
    (var_samp(la) - var_samp(lb) + sqrt(pow(var_samp(la) - var_samp(lb), 2) + 4 * pow(covar_samp(la, lb), 2))) / (2 * covar_samp(la, lb)) AS beta FROM pr GROUP BY fold, a, b)""",
)
def e2(spark, sf_dir):
    fit = E.hedge_tls(in_sample(spark, sf_dir), KEYS)
    out = fit.select(*KEYS, F.format_string("%.4e", "beta").alias("beta"), F.atan("beta").alias("angle"), (F.col("alpha") / F.sqrt(1 + F.col("beta") * F.col("beta"))).alias("offset_"))
    return rounded(out, "angle", "offset_")


SPREAD = "sp AS (SELECT fold, a, b, date, la - beta * lb - alpha AS s FROM pr JOIN (SELECT fold, a, b, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha FROM pr GROUP BY ALL) USING (fold, a, b))"
STEPS = "st AS (SELECT *, lag(s) OVER (PARTITION BY fold, a, b ORDER BY date) AS x, s - lag(s) OVER (PARTITION BY fold, a, b ORDER BY date) AS dx FROM sp)"


@query("e3_spread", *BASE, SPREAD, "SELECT fold, a, b, date, round(s, 8) + 0.0 AS s FROM sp")
def e3(spark, sf_dir):
    return rounded(spreads(spark, sf_dir), "s", digits=8)


@query(
    "e4_half_life", *BASE, SPREAD, STEPS,
    """SELECT fold, a, b, n, CASE WHEN n >= 19 AND 1 + b1 > 0 AND 1 + b1 < 1 THEN round(-ln(2) / ln(1 + b1), 6) END AS half_life
    FROM (SELECT fold, a, b, count(x) AS n, regr_slope(dx, x) AS b1 FROM st GROUP BY fold, a, b)""",
)
def e4(spark, sf_dir):
    return E.half_life(spreads(spark, sf_dir), KEYS).withColumn("half_life", F.round("half_life", 6))


@query(
    "e5_ou_params", *BASE, SPREAD, STEPS,
    """SELECT fold, a, b, round(-ln(1 + b1), 6) AS theta, round(-a1 / b1, 6) + 0.0 AS mu, round(sqrt((yy - b1 * xy) / (n - 2)), 6) AS sigma, round(ln(2) / -ln(1 + b1), 6) AS half_life
    FROM (SELECT fold, a, b, count(x) AS n, regr_slope(dx, x) AS b1, regr_intercept(dx, x) AS a1, regr_syy(dx, x) AS yy, regr_sxy(dx, x) AS xy FROM st GROUP BY fold, a, b)
    WHERE n >= 19 AND 1 + b1 > 0 AND 1 + b1 < 1""",
)
def e5(spark, sf_dir):
    return rounded(E.ou_params(spreads(spark, sf_dir), KEYS).where("theta IS NOT NULL"), "theta", "mu", "sigma", "half_life")


TESTED = "fold, a, b, round(beta, 6) + 0.0 AS beta, round(alpha, 6) + 0.0 AS alpha, n_obs, round(pvalue, 6) AS pvalue, round(tstat, 6) AS tstat, round(half_life, 6) AS half_life, round(resid_std, 6) AS resid_std"


def tested(df):
    return rounded(df, "beta", "alpha", "pvalue", "tstat", "half_life", "resid_std")


@query("e6_engle_granger", *SCAN, f"SELECT {TESTED} FROM tested")
def e6(spark, sf_dir):
    return tested(E.engle_granger(in_sample(spark, sf_dir), KEYS))


def scan_of(spark, sf_dir):
    prices = weekly(spark, sf_dir)
    return E.screen(panel.returns(prices), panel.folds(prices, WEEKLY), WEEKLY)


@query("e7_pair_screen", *SCAN, QUALITY, f"SELECT {TESTED} FROM scan")
def e7(spark, sf_dir):
    return tested(scan_of(spark, sf_dir)).drop("quality")


@query("e8_quality", *SCAN, QUALITY, "SELECT fold, a, b, quality FROM scan")
def e8(spark, sf_dir):
    return scan_of(spark, sf_dir).select(*KEYS, "quality")


@query(
    "e9_rolling_z", *BASE, SPREAD,
    """SELECT fold, a, b, date, CASE WHEN n >= 26 AND sd > 0 THEN round((s - m) / sd, 5) + 0.0 END AS z FROM (SELECT *, count(s) OVER w AS n, avg(s) OVER w AS m, stddev_samp(s) OVER w AS sd
    FROM sp WINDOW w AS (PARTITION BY fold, a, b ORDER BY date ROWS 25 PRECEDING))""",
)
def e9(spark, sf_dir):
    return spreads(spark, sf_dir).select(*KEYS, "date", (F.round(E.rolling_z("s", KEYS, "date", WEEKLY.z_window), 5) + 0.0).alias("z"))


@query("e10_calibrate", *BASE, SPREAD, "SELECT fold, a, b, round(avg(s), 8) + 0.0 AS mu, round(stddev_samp(s), 8) AS sigma FROM sp GROUP BY ALL")
def e10(spark, sf_dir):
    return rounded(E.calibrate(spreads(spark, sf_dir), KEYS), "mu", "sigma", digits=8)


OOS = """oos AS (SELECT p.fold, p.a, p.b, x.date, ln(x.close) - beta * ln(y.close) - alpha AS s, beta FROM picked p JOIN folds f ON f.fold = p.fold
  JOIN panel x ON x.symbol = p.a AND x.date BETWEEN oos_lo AND oos_hi JOIN panel y ON y.symbol = p.b AND y.date = x.date)"""
FROZEN = """cal AS (SELECT fold, a, b, avg(la - beta * lb - alpha) AS mu, stddev_samp(la - beta * lb - alpha) AS sigma FROM pr JOIN picked USING (fold, a, b) GROUP BY ALL),
zs AS (SELECT fold, a, b, date, CASE WHEN sigma > 0 THEN (s - mu) / sigma END AS z, false AS broken, beta FROM oos JOIN cal USING (fold, a, b))"""
PICKED = (*SCAN, QUALITY, FLAGS, 'picked AS (SELECT * FROM flags WHERE quality AND (naive OR bonferroni OR bh OR "by"))', OOS, FROZEN)


def traded(spark, sf_dir, use_regime=False):
    prices = weekly(spark, sf_dir)
    return pairs_book.traded(prices, pairs_book.scan(prices, WEEKLY), WEEKLY, use_regime)


@query("e11_frozen_z", *PICKED, "SELECT fold, a, b, date, round(z, 5) + 0.0 AS z FROM zs")
def e11(spark, sf_dir):
    return rounded(traded(spark, sf_dir).select(*KEYS, "date", "z"), "z", digits=5)


@query(
    "e12_concentration", *SCAN, QUALITY,
    "sel AS (SELECT a, b FROM scan WHERE quality AND pvalue <= 0.05)", "names AS (SELECT a AS symbol FROM sel UNION ALL SELECT b FROM sel)",
    "SELECT symbol, count(*) AS n, round(count(*) / (SELECT count(*) FROM sel), 6) AS share FROM names GROUP BY symbol",
)
def e12(spark, sf_dir):
    return E.concentration(scan_of(spark, sf_dir).where("quality AND pvalue <= 0.05")).withColumn("share", F.round("share", 6))


@query(
    "e13_excess_over_chance", *SCAN, QUALITY,
    """SELECT fold, count(*) AS n_tests, count(*) FILTER (WHERE pvalue < 0.05) AS found, round(0.05 * count(*), 6) AS expected,
    round(count(*) FILTER (WHERE pvalue < 0.05) - 0.05 * count(*), 6) AS excess, round(count(*) FILTER (WHERE pvalue < 0.05) / (0.05 * count(*)), 6) AS ratio FROM scan GROUP BY fold""",
)
def e13(spark, sf_dir):
    return rounded(E.excess_over_chance(scan_of(spark, sf_dir), ["fold"]), "expected", "excess", "ratio")


def flagged(spark, sf_dir):
    return pairs_book.scan(weekly(spark, sf_dir), WEEKLY)


for _id, _name, _column in (("m1", "naive", "naive"), ("m2", "bonferroni", "bonferroni"), ("m3", "benjamini_hochberg", "bh"), ("m4", "benjamini_yekutieli", "by")):

    @query(f"{_id}_{_name}", *SCAN, QUALITY, FLAGS, f'SELECT fold, a, b, round(pvalue, 6) AS pvalue, "{_column}" AS reject FROM flags')
    def _m(spark, sf_dir, column=_column):
        return flagged(spark, sf_dir).select(*KEYS, F.round("pvalue", 6).alias("pvalue"), F.col(column).alias("reject"))


@query(
    "m5_discoveries", *SCAN, QUALITY, FLAGS,
    """SELECT fold, count(*) AS n_tests, count(*) FILTER (WHERE naive) AS n_naive, count(*) FILTER (WHERE bonferroni) AS n_bonferroni, count(*) FILTER (WHERE bh) AS n_bh,
    count(*) FILTER (WHERE "by") AS n_by, round(0.05 * count(*), 6) AS by_chance FROM flags GROUP BY fold""",
)
def m5(spark, sf_dir):
    return multitest.discoveries(flagged(spark, sf_dir), ["fold"]).withColumn("by_chance", F.round("by_chance", 6))


# ---- regimes, over the whole history of all pairs
ALL_PAIRS = """ap AS (SELECT x.symbol AS a, y.symbol AS b, x.date, ln(x.close) AS la, ln(y.close) AS lb, row_number() OVER (PARTITION BY x.symbol, y.symbol ORDER BY x.date) - 1 AS i
  FROM panel x JOIN panel y ON x.date = y.date AND x.symbol < y.symbol)"""
FIT = """fit AS (SELECT *, la - beta * lb - alpha AS s FROM ap JOIN (SELECT a, b, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha FROM ap GROUP BY a, b) USING (a, b)),
zz AS (SELECT *, (s - avg(s) OVER w) / stddev_samp(s) OVER w AS z FROM fit WINDOW w AS (PARTITION BY a, b))"""
TRAIL = "tr AS (SELECT a, b, i, la, lb, s, pt FROM zz JOIN (SELECT unnest(range(52, (SELECT max(i) + 1 FROM zz), 8)) AS pt) ON i >= pt - 52 AND i < pt)"
ROLL_P = (Q.engle_granger("rp", "tr", "a, b, pt", "i"), "pp AS (SELECT a, b, pt AS i, pvalue FROM rp WHERE n_obs >= 0.8 * 52)",
          "rollp AS (SELECT zz.a, zz.b, zz.i, last_value(pvalue IGNORE NULLS) OVER (PARTITION BY zz.a, zz.b ORDER BY zz.i) AS coint_p FROM zz LEFT JOIN pp USING (a, b, i))")
ROLL_HL = """hs AS (SELECT a, b, pt, lag(s) OVER w AS x, s - lag(s) OVER w AS dx FROM tr WINDOW w AS (PARTITION BY a, b, pt ORDER BY i)),
hh AS (SELECT a, b, pt AS i, CASE WHEN count(x) >= 19 AND 1 + regr_slope(dx, x) > 0 AND 1 + regr_slope(dx, x) < 1 THEN -ln(2) / ln(1 + regr_slope(dx, x)) END AS hl FROM hs GROUP BY a, b, pt),
rollh AS (SELECT zz.a, zz.b, zz.i, last_value(hl IGNORE NULLS) OVER (PARTITION BY zz.a, zz.b ORDER BY zz.i) AS roll_hl FROM zz LEFT JOIN hh USING (a, b, i))"""
ROLL_B = """rollb AS (SELECT a, b, i, CASE WHEN count(*) OVER w = 52 THEN covar_samp(la, lb) OVER w / nullif(var_samp(lb) OVER w, 0) END AS roll_beta
  FROM zz WINDOW w AS (PARTITION BY a, b ORDER BY i ROWS 51 PRECEDING))"""
STALE = """isl AS (SELECT *, sum(CASE WHEN abs(z) <= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY i) AS g FROM zz),
stale AS (SELECT a, b, i, row_number() OVER (PARTITION BY a, b, g ORDER BY i) - 1 AS stale FROM isl)"""
HEAD = (Q.PANEL, ALL_PAIRS, FIT)


def history(spark, sf_dir):
    rows = E.with_fit(E.pair_rows(panel.returns(weekly(spark, sf_dir))), ["a", "b"])
    whole = Window.partitionBy("a", "b")
    rows = rows.withColumn("z", (F.col("s") - F.avg("s").over(whole)) / F.stddev_samp("s").over(whole))
    return regime.numbered(rows, ["a", "b"])


AB = ["a", "b"]


@query("r1_rolling_pvalue", *HEAD, TRAIL, *ROLL_P, "SELECT a, b, i, round(coint_p, 6) AS coint_p FROM rollp")
def r1(spark, sf_dir):
    rows = regime.rolling_pvalue(history(spark, sf_dir), AB, 52, 8)
    return rows.select(*AB, F.col("i").cast("long").alias("i"), F.round("coint_p", 6).alias("coint_p"))


@query("r2_rolling_beta", *HEAD, ROLL_B, "SELECT a, b, i, round(roll_beta, 6) + 0.0 AS roll_beta FROM rollb")
def r2(spark, sf_dir):
    return history(spark, sf_dir).select(*AB, F.col("i").cast("long").alias("i"), (F.round(regime.rolling_beta(AB, 52), 6) + 0.0).alias("roll_beta"))


@query("r3_rolling_half_life", *HEAD, TRAIL, ROLL_HL, "SELECT a, b, i, round(roll_hl, 6) AS roll_hl FROM rollh")
def r3(spark, sf_dir):
    rows = regime.rolling_half_life(history(spark, sf_dir), AB, 52, 8)
    return rows.select(*AB, F.col("i").cast("long").alias("i"), F.round("roll_hl", 6).alias("roll_hl"))


@query("r4_since_mean_cross", *HEAD, STALE, "SELECT a, b, i, stale FROM stale")
def r4(spark, sf_dir):
    return regime.since_mean_cross(history(spark, sf_dir), AB).select(*AB, F.col("i").cast("long").alias("i"), F.col("stale").cast("long").alias("stale"))


R5 = """fl AS (SELECT zz.a, zz.b, zz.date, coalesce(coint_p > 0.5, false) AS p_break, coalesce(abs(roll_beta - beta) / greatest(abs(beta), 1e-8) > 0.5, false) AS beta_break,
  coalesce(roll_hl > 60, false) AS hl_break, coalesce(stale > 26, false) AS stale_break FROM zz JOIN rollp USING (a, b, i) JOIN rollb USING (a, b, i) JOIN rollh USING (a, b, i) JOIN stale USING (a, b, i))"""


@query("r5_regime_flags", *HEAD, TRAIL, *ROLL_P, ROLL_HL, ROLL_B, STALE, R5, "SELECT *, p_break OR beta_break OR hl_break OR stale_break AS broken FROM fl")
def r5(spark, sf_dir):
    rows = regime.regime_flags(history(spark, sf_dir).drop("i"), AB, WEEKLY)
    return rows.select(*AB, "date", "p_break", "beta_break", "hl_break", "stale_break", "broken")


@query("p1_pair_positions", *PICKED, Q.positions("ps", "zs"), "SELECT fold, a, b, date, pos FROM ps")
def p1(spark, sf_dir):
    return traded(spark, sf_dir).select(*KEYS, "date", "pos")
