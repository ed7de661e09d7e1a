"""P&L, performance metrics and attribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_pnl(rows: DataFrame, keys: list[str], cost_bps: float = 5.0, order: str = "date") -> DataFrame:
    """Rows (pos, ra, rb, beta) with gross, cost, net, turnover: the position of the row before earns this row's return."""
    before = F.coalesce(F.lag("pos").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0.0))
    w = 1 / (1 + F.abs("beta"))
    rows = rows.withColumn("gross", before * w * (F.col("ra") - F.col("beta") * F.col("rb"))).withColumn("turnover", F.abs(F.col("pos") - before))
    return rows.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))


def whole_mean(column: str) -> Column:
    """Mean that is null as soon as one value is."""
    return F.when(F.count(column) == F.count("*"), F.avg(column))


def equal_weight_book(pnl: DataFrame, keys: list[str]) -> DataFrame:
    """keys (with the date): means of gross, cost, net, turnover over the pairs, share of broken pairs, number of pairs."""
    return pnl.groupBy(*keys).agg(*(whole_mean(c).alias(c) for c in ("gross", "cost", "net", "turnover")), F.avg(F.col("broken").cast("double")).alias("broken_share"), F.count("*").alias("n_pairs"))


def metrics(curves: DataFrame, keys: list[str], net: str = "net", turnover: str | None = None, per_year: int = 252, order: str = "date") -> DataFrame:
    """keys..., days, ann_return, ann_vol, sharpe, max_dd, hit_rate, turnover; null where the series doesn't vary.

    The drawdown is that of the running sum, from its own running maximum.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(net)
    traded = F.sum(turnover) if turnover else F.lit(None).cast("double")
    rows = curves.withColumn("_net", value).withColumn("_curve", F.when(value.isNotNull(), F.sum(value).over(upto)))
    rows = rows.withColumn("_down", F.col("_curve") - F.max("_curve").over(upto))
    m = rows.groupBy(*keys).agg(
        F.count("_net").alias("days"), F.avg("_net").alias("_mean"), F.stddev_samp("_net").alias("_sd"), F.min("_down").alias("_dd"),
        F.avg(F.when(F.col("_net") != 0, (F.col("_net") > 0).cast("double"))).alias("_hit"), traded.alias("_turn"),
    )
    ok = F.col("_sd") > 0
    year, vol = F.col("_mean") * per_year, F.col("_sd") * math.sqrt(per_year)
    out = {"ann_return": year, "ann_vol": vol, "sharpe": year / vol, "max_dd": F.col("_dd"), "hit_rate": F.col("_hit"), "turnover": F.col("_turn") / (F.col("days") / per_year)}
    return m.select(*keys, "days", *(F.when(ok, v).alias(k) for k, v in out.items()))


def cost_sensitivity(curves: DataFrame, keys: list[str], grid: tuple[float, ...] = (0, 1, 2, 5, 10, 20), per_year: int = 252) -> DataFrame:
    """keys..., cost_bps, sharpe, ann_return, max_dd for each cost of a small grid."""
    costs = F.explode(F.array(*(F.lit(float(c)) for c in grid))).alias("cost_bps")
    rows = curves.select("*", costs).withColumn("_after", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 1e4)
    return metrics(rows, [*keys, "cost_bps"], "_after", per_year=per_year).select(*keys, "cost_bps", "sharpe", "ann_return", "max_dd")


def period_metrics(curves: DataFrame, keys: list[str], period: Column, least: int = 20, net: str = "net", per_year: int = 252) -> DataFrame:
    """keys..., period, days, ann_return, sharpe, max_dd of the periods with enough rows."""
    rows = curves.withColumn("period", period)
    enough = rows.groupBy(*keys, "period").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    found = metrics(rows.join(F.broadcast(enough.drop("_n")), [*keys, "period"], "left_semi"), [*keys, "period"], net, per_year=per_year)  # a row a period
    return found.select(*keys, "period", "days", "ann_return", "sharpe", "max_dd")


def drawdown_attribution(curves: DataFrame, keys: list[str], flagged: Column, net: str = "net") -> DataFrame:
    n, bad = F.col(net), F.coalesce(flagged, F.lit(False))
    loss = F.sum(F.when(n < 0, n))
    return curves.groupBy(*keys).agg(
        F.avg(bad.cast("double")).alias("share_days_flagged"),
        F.try_divide(F.coalesce(F.sum(F.when((n < 0) & bad, n)), F.lit(0.0)), loss).alias("share_of_total_loss_flagged"),
        F.avg(F.when(bad, n)).alias("mean_pnl_flagged"),
        F.avg(F.when(~bad, n)).alias("mean_pnl_unflagged"),
    )


def rate_exposure(curves: DataFrame, rates: DataFrame, keys: list[str], net: str = "net", least: int = 50) -> DataFrame:
    """keys..., n, beta, t_stat, r2 of the P&L on changes of the last known rate."""
    by = Window.partitionBy(*keys).orderBy("date")
    joined = curves.join(F.broadcast(rates.select("date", "tnx")), "date", "left")  # a row a session
    joined = joined.withColumn("tnx", F.last("tnx", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.withColumn("dy", F.col("tnx") - F.lag("tnx").over(by)).where(f"dy IS NOT NULL AND {net} IS NOT NULL")
    m = joined.groupBy(*keys).agg(F.count("*").alias("n"), *(f(net, "dy").alias(k) for k, f in (("beta", F.regr_slope), ("xx", F.regr_sxx), ("yy", F.regr_syy), ("xy", F.regr_sxy), ("r2", F.regr_r2))))
    rss = F.col("yy") - F.col("beta") * F.col("xy")
    enough = F.col("n") >= least
    t = F.col("beta") / F.sqrt(rss / (F.col("n") - 2) / F.col("xx"))
    return m.select(*keys, "n", F.when(enough, F.col("beta")).alias("beta"), F.when(enough, t).alias("t_stat"), F.when(enough, F.col("r2")).alias("r2"))


def breakeven(curves: DataFrame, keys: list[str], per_year: int = 252) -> DataFrame:
    """keys..., breakeven_bps: the cost at which the mean net return is zero."""
    return curves.groupBy(*keys).agg((1e4 * F.try_divide(F.avg("gross") * per_year, F.sum("turnover") / (F.count("gross") / per_year))).alias("breakeven_bps"))


def book_pnl(weights: DataFrame, next_returns: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """date (of the return), gross, turnover, net, n_pos, gross_exposure of a book of weights (date, symbol, w).

    A missing return counts as 0; the weight before the first processed date is 0.
    """
    change = F.abs(F.col("w") - F.coalesce(F.lag("w").over(Window.partitionBy("symbol").orderBy("date")), F.lit(0.0)))
    rows = weights.withColumn("_turn", change).join(next_returns.select("date", "symbol", "r_next"), ["date", "symbol"], "left")
    out = rows.groupBy("date").agg(
        F.sum(F.col("w") * F.coalesce("r_next", F.lit(0.0))).alias("gross"), F.sum("_turn").alias("turnover"), F.count_if(F.col("w") != 0).alias("n_pos"), F.sum(F.abs("w")).alias("gross_exposure")
    )
    return out.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)
