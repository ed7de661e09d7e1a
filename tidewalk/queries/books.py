"""P&L, metrics, attribution, and the walk-forward pairs study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pnl
from ..params import WEEKLY
from ..plans import pairs_book
from ..registry import query
from ..sources import panels
from . import sql as Q
from .pairs import KEYS, PICKED, rounded, traded
from .panels import weekly

YEAR = WEEKLY.periods_per_year
PNL = """legs AS (SELECT p.*, ra.ret AS ra, rb.ret AS rb, z.beta FROM ps p JOIN zs z USING (fold, a, b, date)
  JOIN rets ra ON ra.symbol = p.a AND ra.date = p.date JOIN rets rb ON rb.symbol = p.b AND rb.date = p.date),
held AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY fold, a, b ORDER BY date), 0.0) AS before FROM legs),
pnl AS (SELECT *, before / (1 + abs(beta)) * (ra - beta * rb) AS gross, abs(pos - before) AS turnover FROM held),
net AS (SELECT *, turnover * 5 / 1e4 AS cost, gross - turnover * 5 / 1e4 AS net FROM pnl)"""
BOOK = """methods AS (SELECT n.*, m.method FROM net n JOIN picked k USING (fold, a, b) JOIN (SELECT unnest(['naive', 'bonferroni', 'bh', 'by']) AS method) m
  ON (m.method = 'naive' AND k.naive) OR (m.method = 'bonferroni' AND k.bonferroni) OR (m.method = 'bh' AND k.bh) OR (m.method = 'by' AND k."by")),
book AS (SELECT method, fold, date, CASE WHEN count(gross) = count(*) THEN avg(gross) END AS gross, CASE WHEN count(cost) = count(*) THEN avg(cost) END AS cost,
  CASE WHEN count(net) = count(*) THEN avg(net) END AS net, CASE WHEN count(turnover) = count(*) THEN avg(turnover) END AS turnover,
  avg(CASE WHEN broken THEN 1.0 ELSE 0.0 END) AS broken_share, count(*) AS n_pairs FROM methods GROUP BY method, fold, date)"""
LEGS = (*PICKED, Q.RETS, Q.positions("ps", "zs"), PNL)
BOOKS = (*LEGS, BOOK)


def books(spark, sf_dir):
    return pairs_book.books(traded(spark, sf_dir))


def r(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())


@query("a1_pair_pnl", *LEGS, f"SELECT fold, a, b, date, pos, {r('gross cost net turnover', 8)} FROM net")
def a1(spark, sf_dir):
    return rounded(traded(spark, sf_dir).select(*KEYS, "date", "pos", "gross", "cost", "net", "turnover"), "gross", "cost", "net", "turnover", digits=8)


NAMES = "ann_return ann_vol sharpe max_dd hit_rate turnover"


@query("a2_pair_book_metrics", *BOOKS, f"SELECT method, fold, days, {r(NAMES, 5)} FROM {Q.metrics('book', 'method, fold', turnover='turnover')}")
def a2(spark, sf_dir):
    return rounded(pnl.metrics(books(spark, sf_dir), ["method", "fold"], turnover="turnover", per_year=YEAR), *NAMES.split(), digits=5)


COSTS = "costed AS (SELECT method, date, c AS cost_bps, gross - turnover * c / 1e4 AS net FROM book CROSS JOIN (SELECT unnest([0.0, 1.0, 2.0, 5.0, 10.0, 20.0])::DOUBLE AS c))"


@query("a3_cost_sensitivity", *BOOKS, COSTS, f"SELECT method, cost_bps, {r('sharpe ann_return max_dd', 5)} FROM {Q.metrics('costed', 'method, cost_bps')}")
def a3(spark, sf_dir):
    return rounded(pnl.cost_sensitivity(books(spark, sf_dir), ["method"], per_year=YEAR), "sharpe", "ann_return", "max_dd", digits=5)


YEARS = "years AS (SELECT *, year(date) AS period FROM book QUALIFY count(*) OVER (PARTITION BY method, year(date)) >= 20)"


@query("a4_subperiods", *BOOKS, YEARS, f"SELECT method, CAST(period AS INTEGER) AS period, days, {r('ann_return sharpe max_dd', 5)} FROM {Q.metrics('years', 'method, period')}")
def a4(spark, sf_dir):
    return rounded(pnl.period_metrics(books(spark, sf_dir), ["method"], F.year("date"), per_year=YEAR), "ann_return", "sharpe", "max_dd", digits=5)


@query(
    "a5_drawdown_attribution", *BOOKS,
    """SELECT method, round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS share_days_flagged, round(coalesce(sum(net) FILTER (WHERE net < 0 AND f), 0) / sum(net) FILTER (WHERE net < 0), 6) AS share_of_total_loss_flagged,
    round(avg(net) FILTER (WHERE f), 8) + 0.0 AS mean_pnl_flagged, round(avg(net) FILTER (WHERE NOT f), 8) + 0.0 AS mean_pnl_unflagged FROM (SELECT *, month(date) % 3 = 0 AS f FROM book) GROUP BY method""",
)
def a5(spark, sf_dir):
    out = pnl.drawdown_attribution(books(spark, sf_dir), ["method"], F.month("date") % 3 == 0)
    return rounded(rounded(out, "share_days_flagged", "share_of_total_loss_flagged"), "mean_pnl_flagged", "mean_pnl_unflagged", digits=8)


@query(
    "a6_rate_exposure", *BOOKS, Q.RATES,
    "filled AS (SELECT method, date, net, last_value(tnx IGNORE NULLS) OVER (PARTITION BY method ORDER BY date) AS tnx FROM book LEFT JOIN rates USING (date))",
    "moved AS (SELECT *, tnx - lag(tnx) OVER (PARTITION BY method ORDER BY date) AS dy FROM filled)",
    """SELECT method, n, round(beta * 1e6, 6) + 0.0 AS beta, round(beta / sqrt((yy - beta * xy) / (n - 2) / xx), 5) + 0.0 AS t_stat, round(r2, 6) AS r2 FROM (SELECT method, count(*) AS n, regr_slope(net, dy) AS beta,
    regr_sxx(net, dy) AS xx, regr_syy(net, dy) AS yy, regr_sxy(net, dy) AS xy, regr_r2(net, dy) AS r2 FROM moved WHERE dy IS NOT NULL AND net IS NOT NULL GROUP BY method) WHERE n >= 50""",
)
def a6(spark, sf_dir):
    out = pnl.rate_exposure(books(spark, sf_dir), panels.rate_series(spark, sf_dir), ["method"]).where("n >= 50")
    return rounded(rounded(out.withColumn("beta", F.col("beta") * 1e6), "beta", "r2"), "t_stat", digits=5)


@query("a7_summary", *BOOKS, f"SELECT method, days, {r('ann_return ann_vol sharpe max_dd hit_rate', 5)} FROM {Q.metrics('book', 'method')}")
def a7(spark, sf_dir):
    return rounded(pnl.metrics(books(spark, sf_dir), ["method"], per_year=YEAR).drop("turnover"), *NAMES.split()[:-1], digits=5)


@query("a8_equal_weight_book", *BOOKS, f"SELECT method, fold, date, {r('gross cost net turnover broken_share', 8)}, n_pairs FROM book")
def a8(spark, sf_dir):
    return rounded(books(spark, sf_dir), "gross", "cost", "net", "turnover", "broken_share", digits=8)


@query("a9_breakeven_cost", *BOOKS, "SELECT method, round(1e4 * avg(gross) * 52 / (sum(turnover) / (count(gross) / 52.0)), 4) + 0.0 AS breakeven_bps FROM book GROUP BY method")
def a9(spark, sf_dir):
    return rounded(pnl.breakeven(books(spark, sf_dir), ["method"], YEAR), "breakeven_bps", digits=4)


@query(
    "a12_paired_books", *BOOKS,
    """SELECT x.method, count(*) AS days, round(avg(x.net - y.net), 8) + 0.0 AS mean_difference, count(*) FILTER (WHERE x.net < y.net) AS n_worse
    FROM book x JOIN (SELECT date, avg(net) AS net FROM book WHERE method = 'naive' GROUP BY date) y ON x.date = y.date GROUP BY x.method""",
)
def a12(spark, sf_dir):
    all_books = books(spark, sf_dir)
    base = all_books.where("method = 'naive'").groupBy("date").agg(F.avg("net").alias("base"))
    gap = F.col("net") - F.col("base")
    return all_books.join(base, "date").groupBy("method").agg(F.count("*").alias("days"), (F.round(F.avg(gap), 8) + 0.0).alias("mean_difference"), F.count_if(F.col("net") < F.col("base")).alias("n_worse"))


SPLIT = "parts AS (SELECT *, CASE WHEN year(date) < 2000 THEN 'early' ELSE 'late' END AS period FROM book)"


@query("a13_split_periods", *BOOKS, SPLIT, f"SELECT method, period, days, {r('ann_return sharpe max_dd', 5)} FROM {Q.metrics('parts', 'method, period', per_year=365)}")
def a13(spark, sf_dir):
    out = pnl.period_metrics(books(spark, sf_dir), ["method"], F.when(F.year("date") < 2000, "early").otherwise("late"), least=1, per_year=365)
    return rounded(out, "ann_return", "sharpe", "max_dd", digits=5)


@query("w1_one_fold", *BOOKS, f"SELECT fold, method, date, {r('net', 8)} FROM book WHERE fold = 1999")
def w1(spark, sf_dir):
    return rounded(books(spark, sf_dir).where("fold = 1999").select("fold", "method", "date", "net"), "net", digits=8)


@query("w2_walk_forward")
def w2(spark, sf_dir):
    out = pairs_book.walk_forward(weekly(spark, sf_dir), WEEKLY, panels.members_by_volume(weekly(spark, sf_dir), panels.snapshot_dates(spark, "1995-07-01", "2001-07-01", 6)))
    return rounded(out, "gross", "cost", "net", "turnover", "broken_share", digits=8)
