"""Factor residuals, scores, position rules with memory, sizing, and cross-sectional books."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import factor, panel, pnl, positions
from ..params import WEEKLY
from ..plans import statarb
from ..registry import query
from ..sources import panels
from . import sql as Q
from .pairs import rounded
from .panels import weekly

W = WEEKLY.reg_window
P = replace(WEEKLY, quantile=0.15, s_open=0.8, s_close_long=0.2, s_close_short=0.3)
BASE = (Q.PANEL, Q.CALENDAR, Q.RETS, "mkt AS (SELECT didx, avg(ret) AS f FROM rets GROUP BY didx)")
COPIED = f"cp AS (SELECT symbol, didx, ret, f, t FROM rets JOIN mkt USING (didx) JOIN (SELECT didx AS t FROM calendar) ON didx > t - {W} AND didx <= t WHERE ret IS NOT NULL)"
FITTED = f"ft AS (SELECT symbol, t, regr_slope(ret, f) AS beta, regr_intercept(ret, f) AS alpha FROM cp GROUP BY symbol, t HAVING count(*) = {W})"
RESID = "rs AS (SELECT symbol, t, didx, ret - alpha - beta * f AS resid, beta, alpha FROM cp JOIN ft USING (symbol, t))"
SCORES = """cx AS (SELECT *, sum(resid) OVER (PARTITION BY symbol, t ORDER BY didx) AS x1 FROM rs),
cl AS (SELECT *, lag(x1) OVER (PARTITION BY symbol, t ORDER BY didx) AS x0 FROM cx),
ou AS (SELECT symbol, t, arg_max(x1, didx) AS last, count(x0) AS n, regr_slope(x1, x0) AS b, regr_intercept(x1, x0) AS a, regr_syy(x1, x0) AS yy, regr_sxy(x1, x0) AS xy FROM cl GROUP BY symbol, t),
oz AS (SELECT *, greatest(yy - b * xy, 0) / greatest(n - 2, 1) AS zeta, b > 0 AND b < 1 AS ok FROM ou),
oq AS (SELECT *, CASE WHEN ok THEN a / (1 - b) END AS m, CASE WHEN ok THEN sqrt(zeta / (1 - b * b)) END AS sigma_eq FROM oz),
sc AS (SELECT symbol, t, CASE WHEN sigma_eq > 0 THEN (last - m) / sigma_eq END AS s_score, CASE WHEN ok THEN -ln(b) * 252 END AS kappa, m, sigma_eq, b, sqrt(zeta) AS sigma_step FROM oq),
tr AS (SELECT *, coalesce(s_score IS NOT NULL AND ln(2) / kappa * 52 <= 60, false) AS tradable FROM sc)"""
SC = (*BASE, COPIED, FITTED, RESID, SCORES)
NEXT = "nx AS (SELECT tr.*, r.ret - alpha - beta * f AS r_next FROM tr JOIN ft USING (symbol, t) LEFT JOIN rets r ON r.symbol = tr.symbol AND r.didx = t + 1 LEFT JOIN mkt ON mkt.didx = t + 1)"


def rets_of(spark, sf_dir):
    return panel.returns(weekly(spark, sf_dir))


def residuals(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    return factor.window_residuals(rets, factor.market_factor(rets), W)


def scores(spark, sf_dir):
    return factor.ou_scores(residuals(spark, sf_dir)).withColumn("tradable", factor.tradable(WEEKLY))


def with_next(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    market = factor.market_factor(rets)
    resid = factor.window_residuals(rets, market, W)
    fit = resid.select("symbol", "t", "alpha", "beta").dropDuplicates(["symbol", "t"])
    after = rets.select("symbol", (F.col("didx") - 1).alias("t"), "ret").join(F.broadcast(market.select((F.col("didx") - 1).alias("t"), "f")), "t")
    out = factor.ou_scores(resid).withColumn("tradable", factor.tradable(WEEKLY)).join(fit, ["symbol", "t"]).join(after, ["symbol", "t"], "left")
    return out.withColumn("r_next", F.col("ret") - F.col("alpha") - F.col("beta") * F.col("f"))


@query(
    "f1_marchenko_pastur",
    "SELECT CAST(s_nationkey AS BIGINT) AS nation, least(greatest(count(*) FILTER (WHERE v > edge), 1), 30) AS k FROM (SELECT *, s_acctbal / 1000 AS v, pow(1 + sqrt(count(*) OVER (PARTITION BY s_nationkey) / 52.0), 2) AS edge FROM supplier) GROUP BY s_nationkey",
)
def f1(spark, sf_dir):
    values = panels.load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_acctbal") / 1000).alias("value"))
    return factor.marchenko_pastur_count(values, ["nation"], 52)


@query("f2_eigenportfolios")
def f2(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    q = factor.loadings(factor.processed(rets, None, WEEKLY), rets, WEEKLY)
    return q.select("refresh", "symbol", F.posexplode("q").alias("factor", "q")).withColumn("q", F.round("q", 6))


EQUAL = "eq AS (SELECT date, symbol, 0 AS factor, 1.0 / count(*) OVER (PARTITION BY date) AS q FROM rets WHERE ret IS NOT NULL)"


@query("f3_factor_returns", *BASE, EQUAL, "SELECT date, factor, round(sum(ret * q), 8) + 0.0 AS f FROM rets JOIN eq USING (date, symbol) GROUP BY date, factor")
def f3(spark, sf_dir):
    from pyspark.sql import Window

    rets = rets_of(spark, sf_dir).where("ret IS NOT NULL")
    q = rets.select("date", "symbol", F.lit(0).alias("factor"), (1 / F.count("*").over(Window.partitionBy("date"))).alias("q"))
    return rounded(factor.factor_returns(rets.select("date", "symbol", "ret"), q), "f", digits=8)


@query("f4_market_residuals", *BASE, COPIED, FITTED, RESID, "SELECT symbol, t, round(resid, 7) + 0.0 AS resid, round(beta, 5) + 0.0 AS beta, round(alpha, 7) + 0.0 AS alpha FROM rs WHERE didx = t")
def f4(spark, sf_dir):
    return rounded(rounded(residuals(spark, sf_dir).where("didx = t").drop("didx"), "resid", "alpha", digits=7), "beta", digits=5)


@query("f5_ou_scores", *SC, "SELECT symbol, t, round(s_score, 4) + 0.0 AS s_score, round(b, 5) + 0.0 AS b, round(sigma_step, 6) AS sigma_step, round(kappa, 3) AS kappa FROM sc")
def f5(spark, sf_dir):
    out = scores(spark, sf_dir).select("symbol", "t", "s_score", "b", "sigma_step", "kappa")
    return rounded(rounded(rounded(rounded(out, "s_score", digits=4), "b", digits=5), "sigma_step"), "kappa", digits=3).withColumn("kappa", F.col("kappa"))


@query("f6_tradable", *SC, "SELECT symbol, t, tradable FROM tr")
def f6(spark, sf_dir):
    return scores(spark, sf_dir).select("symbol", "t", "tradable")


SHAPE = """kn AS (SELECT * FROM nx WHERE s_score IS NOT NULL AND r_next IS NOT NULL),
cu AS (SELECT quantile_cont(s_score, [0.0, 0.02, 0.05, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90, 0.95, 0.98, 1.0]) AS cuts FROM kn),
bn AS (SELECT *, len(list_filter(cuts, lambda c: c <= s_score)) - 1 AS bin FROM kn, cu)"""


@query(
    "f7_signal_shape", *SC, NEXT, SHAPE,
    "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(s_score), 4) AS mean_s, round(1e4 * avg(r_next), 3) AS mean_bp, round(avg(r_next) / (stddev_samp(r_next) / sqrt(count(*))), 4) AS t_stat FROM bn WHERE bin < 12 GROUP BY bin HAVING count(*) >= 20",
)
def f7(spark, sf_dir):
    out = factor.signal_shape(with_next(spark, sf_dir), 20)
    return rounded(rounded(out, "mean_s", "t_stat", digits=4), "mean_bp", digits=3)


# ---- position rules on the market model's scores
DATED = "dt AS (SELECT tr.*, date, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM tr JOIN calendar ON didx = t)"
BANDS = """bp AS (SELECT symbol, i, date, s_score, CASE WHEN NOT tradable THEN 0.0 WHEN s_score < -0.8 THEN 1.0 WHEN s_score > 0.8 THEN -1.0 ELSE 0.0 END AS pos FROM dt WHERE i = 1
 UNION ALL SELECT d.symbol, d.i, d.date, d.s_score, CASE WHEN NOT d.tradable THEN 0.0 WHEN p.pos = 0 THEN CASE WHEN d.s_score < -0.8 THEN 1.0 WHEN d.s_score > 0.8 THEN -1.0 ELSE 0.0 END
  WHEN p.pos > 0 AND d.s_score > 0.2 THEN 0.0 WHEN p.pos < 0 AND d.s_score < 0.3 THEN 0.0 ELSE p.pos END FROM bp p JOIN dt d ON d.symbol = p.symbol AND d.i = p.i + 1)"""


def dated(spark, sf_dir):
    days = panel.calendar(weekly(spark, sf_dir)).withColumnRenamed("didx", "t")
    return scores(spark, sf_dir).join(F.broadcast(days), "t")


def banded(spark, sf_dir):
    return positions.band_positions(dated(spark, sf_dir).withColumn("present", F.lit(True)), P)


@query("p2_band_positions", *SC, DATED, BANDS, "SELECT symbol, date, pos FROM bp")
def p2(spark, sf_dir):
    return banded(spark, sf_dir).select("symbol", "date", "pos")


QUANT = """qn AS (SELECT *, tradable AND s_score IS NOT NULL AS known, count(*) FILTER (WHERE tradable AND s_score IS NOT NULL) OVER (PARTITION BY date) AS n FROM dt),
qk AS (SELECT *, greatest(round_even(0.15 * n, 0), 1) AS k, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN known THEN -s_score END ASC NULLS LAST, symbol) AS low,
 row_number() OVER (PARTITION BY date ORDER BY CASE WHEN known THEN -s_score END DESC NULLS LAST, symbol DESC) AS high FROM qn)"""


@query("p3_quantile_positions", *SC, DATED, QUANT, "SELECT symbol, date, CASE WHEN NOT known OR n < 10 THEN 0.0 WHEN low <= k THEN -1.0 WHEN high <= k THEN 1.0 ELSE 0.0 END AS pos FROM qk")
def p3(spark, sf_dir):
    rows = dated(spark, sf_dir).withColumn("signal", -F.col("s_score"))
    return positions.quantile_positions(rows, "signal", P, least=10).select("symbol", "date", "pos")


OPT = """og AS (SELECT symbol, date, i, tradable, coalesce(-(1 - b) * sigma_eq * s_score / least(greatest(1 - b, 1e-3), 1.0) / CASE WHEN sigma_step > 0 THEN 5e4 * sigma_step * sigma_step END, 0.0) AS goal,
  0.0002 / CASE WHEN sigma_step > 0 THEN 5e4 * sigma_step * sigma_step END AS band FROM dt),
op AS (SELECT symbol, i, date, CASE WHEN tradable AND band IS NOT NULL THEN sign(goal) * greatest(abs(goal) - band, 0) ELSE 0.0 END AS pos FROM og WHERE i = 1
 UNION ALL SELECT g.symbol, g.i, g.date, CASE WHEN NOT g.tradable THEN 0.0 WHEN g.band IS NULL THEN p.pos ELSE p.pos + sign(g.goal - p.pos) * greatest(abs(g.goal - p.pos) - g.band, 0) END
 FROM op p JOIN og g ON g.symbol = p.symbol AND g.i = p.i + 1)"""


@query("p4_optimal_positions", *SC, DATED, OPT, "SELECT symbol, date, round(pos, 7) + 0.0 AS pos FROM op")
def p4(spark, sf_dir):
    return rounded(positions.optimal_positions(dated(spark, sf_dir), P).select("symbol", "date", "pos"), "pos", digits=7)


def _bins() -> str:
    return "CASE WHEN s_score IS NOT NULL THEN " + " + ".join(f"CASE WHEN s_score >= {e} THEN 1 ELSE 0 END" for e in positions.EDGES) + " END"


EMP = f"""eb AS (SELECT *, t - {W} AS u, {_bins()} AS bin FROM nx),
ea AS (SELECT bin, u + 1 AS u, count(*) AS n, sum(r_next) AS r FROM eb WHERE bin IS NOT NULL AND r_next IS NOT NULL GROUP BY ALL),
er AS (SELECT DISTINCT u FROM eb WHERE u % 13 = 0 AND u >= 26),
et AS (SELECT er.u, bin, CASE WHEN sum(n) >= 20 THEN 0.5 * sum(r) / sum(n) ELSE 0.0 END AS mu FROM er JOIN ea ON ea.u <= er.u GROUP BY ALL)"""


@query("p5_empirical_mu", *SC, NEXT, EMP, "SELECT symbol, eb.u AS t, round(coalesce(mu, 0.0), 8) + 0.0 AS mu FROM eb LEFT JOIN et ON et.bin = eb.bin AND et.u = eb.u // 13 * 13 AND eb.u // 13 * 13 >= 26")
def p5(spark, sf_dir):
    rows = with_next(spark, sf_dir).withColumn("t", F.col("t") - W).withColumn("date", F.col("t"))
    return rounded(positions.empirical_mu(rows, WEEKLY).select("symbol", "t", "mu"), "mu", digits=8)


@query("p6_inverse_risk", *SC, DATED, BANDS, "SELECT symbol, date, round(CASE WHEN sigma_step > 0 THEN pos / sigma_step ELSE 0.0 END, 5) + 0.0 AS sized FROM bp JOIN dt USING (symbol, i, date)")
def p6(spark, sf_dir):
    return rounded(positions.inverse_risk(banded(spark, sf_dir)).select("symbol", "date", "sized"), "sized", digits=5)


WEIGHTS = """ld AS (SELECT dt.symbol, date, beta, 1.0 / count(*) OVER (PARTITION BY date) AS q FROM dt JOIN ft USING (symbol, t)),
np AS (SELECT symbol, date, CASE WHEN sum(abs(pos)) OVER (PARTITION BY date) > 0 THEN pos / sum(abs(pos)) OVER (PARTITION BY date) ELSE 0.0 END AS p FROM bp),
ex AS (SELECT date, sum(p * beta) AS f FROM np JOIN ld USING (symbol, date) GROUP BY date),
wt AS (SELECT symbol, date, p - q * f AS w FROM np JOIN ld USING (symbol, date) JOIN ex USING (date))"""
WT = (*SC, DATED, BANDS, WEIGHTS)


def weights(spark, sf_dir):
    from pyspark.sql import Window

    placed = banded(spark, sf_dir)
    fit = residuals(spark, sf_dir).select("symbol", "t", "beta").dropDuplicates(["symbol", "t"])
    loads = placed.select("symbol", "t", "date").join(fit, ["symbol", "t"]).select("date", "symbol", F.lit(0).alias("factor"), "beta", (1 / F.count("*").over(Window.partitionBy("date"))).alias("q"))
    return positions.book_weights(placed.withColumn("sized", F.col("pos")), loads)


@query("p7_book_weights", *WT, "SELECT symbol, date, round(w, 8) + 0.0 AS w FROM wt")
def p7(spark, sf_dir):
    return rounded(weights(spark, sf_dir), "w", digits=8)


HELD = """hs AS (SELECT *, sum(abs(w)) OVER (PARTITION BY date) / 25.0 AS least, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM wt),
hd AS (SELECT symbol, i, date, CASE WHEN abs(w) < least THEN 0.0 ELSE w END AS held FROM hs WHERE i = 1
 UNION ALL SELECT h.symbol, h.i, h.date, CASE WHEN abs(h.w - p.held) < h.least THEN p.held ELSE h.w END FROM hd p JOIN hs h ON h.symbol = p.symbol AND h.i = p.i + 1)"""


@query("p8_no_trade_band", *WT, HELD, "SELECT symbol, date, round(held, 7) + 0.0 AS held FROM hd")
def p8(spark, sf_dir):
    return rounded(positions.no_trade_band(weights(spark, sf_dir), 1.0, 25).select("symbol", "date", "held"), "held", digits=7)


@query(
    "p9_external_signal", *SC, DATED,
    "SELECT symbol, date, round(-(kappa - avg(kappa) OVER (PARTITION BY date)) / nullif(stddev_pop(kappa) OVER (PARTITION BY date), 0), 5) + 0.0 AS s_score FROM dt",
)
def p9(spark, sf_dir):
    return rounded(positions.external_signal(dated(spark, sf_dir), "kappa").select("symbol", "date", "s_score"), "s_score", digits=5)


@query("p10_external_mu", *SC, DATED, "SELECT symbol, date, CASE WHEN b > 0.5 THEN round(b, 5) ELSE 0.0 END AS mu FROM dt")
def p10(spark, sf_dir):
    rows = dated(spark, sf_dir)
    return positions.external_mu(rows, rows.where("b > 0.5").select("date", "symbol", F.round("b", 5).alias("mu"))).select("symbol", "date", "mu")


BOOKED = """ch AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY date), 0.0)) AS turn FROM wt),
bk AS (SELECT c.date, sum(w * coalesce(r.ret, 0.0)) AS gross, sum(turn) AS turnover, count(*) FILTER (WHERE w <> 0) AS n_pos, sum(abs(w)) AS gross_exposure
  FROM ch c JOIN calendar USING (date) LEFT JOIN rets r ON r.symbol = c.symbol AND r.didx = calendar.didx + 1 GROUP BY c.date)"""


@query("a10_book_pnl", *WT, BOOKED, "SELECT date, round(gross, 8) + 0.0 AS gross, round(turnover, 7) AS turnover, round(gross - turnover * 5 / 1e4, 8) + 0.0 AS net, round(gross_exposure, 7) AS gross_exposure FROM bk")
def a10(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    days = rets.select("didx", "date").distinct()
    after = rets.select((F.col("didx") - 1).alias("didx"), "symbol", F.col("ret").alias("r_next")).join(F.broadcast(days), "didx")
    out = pnl.book_pnl(weights(spark, sf_dir), after, 5.0).drop("n_pos")
    return rounded(rounded(out, "gross", "net", digits=8), "turnover", "gross_exposure", digits=7)


def curve(rows):
    return rounded(rows, "gross", "turnover", "net", "gross_exposure")


@query("w3_statarb")
def w3(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    return curve(statarb.run(rets, None, replace(WEEKLY, no_trade_band=1.0)))


@query("w3b_statarb_optimal_empirical")
def w3b(spark, sf_dir):
    return curve(statarb.run(rets_of(spark, sf_dir), None, WEEKLY, rule="optimal", mu_mode="empirical", n_factors="mp"))


@query("w3c_statarb_quantile")
def w3c(spark, sf_dir):
    return curve(statarb.run(rets_of(spark, sf_dir), None, WEEKLY, rule="quantile", risk_scale=True, adv_quantile=(0.1, 1.0)))


@query("a11_turnover_grid")
def a11(spark, sf_dir):
    rets = rets_of(spark, sf_dir)
    out = None
    for band in (0.0, 1.0):
        one = pnl.metrics(statarb.run(rets, None, replace(WEEKLY, no_trade_band=band)).withColumn("band", F.lit(band)), ["band"], "gross", "turnover", per_year=52)
        out = one if out is None else out.unionByName(one)
    return rounded(out, "ann_return", "ann_vol", "sharpe", "max_dd", "hit_rate", "turnover")


SEEDS = "flip AS (SELECT seed, symbol, date, ret * CASE WHEN substr(md5(strftime(date, '%Y-%m-%d') || '/' || seed), 1, 1) < '8' THEN 1 ELSE -1 END AS ret FROM rets CROSS JOIN (SELECT unnest([1, 2, 3]) AS seed))"


@query("w4_sign_flip_null", *BASE, SEEDS, "SELECT symbol, date, round(ret, 7) + 0.0 AS ret FROM flip WHERE seed = 1")
def w4(spark, sf_dir):
    return rounded(statarb.sign_flipped(rets_of(spark, sf_dir), 1).select("symbol", "date", "ret"), "ret", digits=7)


@query(
    "w5_null_seeds", *BASE, SEEDS,
    "mk AS (SELECT seed, date, avg(ret) AS net FROM flip GROUP BY ALL)",
    f"SELECT seed, days, round(sharpe, 5) + 0.0 AS sharpe FROM {Q.metrics('mk', 'seed')}",
)
def w5(spark, sf_dir):
    seeds = spark.range(1, 4).select(F.col("id").cast("int").alias("seed"))
    market = statarb.sign_flipped(rets_of(spark, sf_dir), seeds).groupBy("seed", "date").agg(F.avg("ret").alias("net"))
    return rounded(pnl.metrics(market, ["seed"], per_year=52).select("seed", "days", "sharpe"), "sharpe", digits=5)
