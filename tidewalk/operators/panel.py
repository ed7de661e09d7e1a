"""Cleaning and panel primitives on (symbol, date, close, dollar_volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAILY, Params


def calendar(panel: DataFrame) -> DataFrame:
    """date, didx: the sessions of the whole panel, numbered. One row a date, so one task orders them."""
    dates = panel.select("date").distinct()
    return dates.withColumn("didx", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def with_index(panel: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(calendar(panel)), "date")  # a row a session: thousands, whatever the number of symbols


def gap_return(close: Column, didx: Column, over: Window) -> Column:
    """Simple return, null unless the row before is the session before."""
    return F.when(didx - F.lag(didx).over(over) == 1, close / F.lag(close).over(over) - 1)


def returns(panel: DataFrame) -> DataFrame:
    """The panel with didx, log_px and ret; a gap of even one session makes ret null."""
    by = Window.partitionBy("symbol").orderBy("didx")
    return with_index(panel.where("close IS NOT NULL")).withColumn("log_px", F.ln("close")).withColumn("ret", gap_return(F.col("close"), F.col("didx"), by))


def dense(panel: DataFrame, symbols: DataFrame) -> DataFrame:
    """All sessions x symbols; what did not trade is null. The spine is made of two small dimensions."""
    spine = calendar(panel).join(F.broadcast(symbols.select("symbol").distinct()))
    return spine.join(panel, ["date", "symbol"], "left")


def filled(column: str, keys: list[str], order: str) -> Column:
    """Last known value, never a later one."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def coverage_filter(panel: DataFrame, p: Params = DAILY) -> DataFrame:
    """Rows of the sessions on which enough of the living symbols trade; a symbol lives from its first to its last price."""
    priced = panel.where("close IS NOT NULL")
    spans = priced.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    events = spans.select(F.col("lo").alias("date"), F.lit(1).alias("d")).union(spans.select(F.date_add("hi", 1), F.lit(-1)))
    steps = events.groupBy("date").agg(F.sum("d").alias("d")).withColumn("traded", F.lit(None).cast("long"))
    traded = priced.groupBy("date").agg(F.count("*").alias("traded")).select("date", F.lit(0).cast("long").alias("d"), "traded")
    order = Window.orderBy("date", F.col("traded").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # a row or two a session
    alive = steps.select("date", "d", "traded").union(traded).withColumn("alive", F.sum("d").over(order)).where("traded IS NOT NULL")
    keep = alive.where(F.col("traded") / F.greatest("alive", F.lit(1)) >= p.min_coverage).select("date")
    return panel.join(F.broadcast(keep), "date", "left_semi")


def coverage_report(panel: DataFrame) -> DataFrame:
    """symbol, first, last, n_obs, n_gap inside the span, coverage of all sessions."""
    rows = with_index(panel.where("close IS NOT NULL"))
    sessions = F.broadcast(calendar(panel).agg(F.count("*").alias("sessions")))
    spans = rows.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_obs"), (F.max("didx") - F.min("didx") + 1).alias("span"))
    return spans.join(sessions).select("symbol", "first", "last", "n_obs", (F.col("span") - F.col("n_obs")).alias("n_gap"), F.round(F.col("n_obs") / F.greatest("sessions", F.lit(1)), 3).alias("coverage"))


def folds(panel: DataFrame, p: Params = DAILY) -> DataFrame:
    """fold (first out-of-sample year), is_lo, is_hi, oos_lo, oos_hi, n_is, n_oos, selection_date (last in-sample session)."""
    year = F.year("date")
    starts = panel.sparkSession.range(p.first_year, p.last_year - p.is_years + 1).select(F.col("id").cast("int").alias("y"))
    dates = calendar(panel).join(F.broadcast(starts), (year >= F.col("y")) & (year < F.col("y") + p.is_years + p.oos_years))
    inside = year < F.col("y") + p.is_years
    out = dates.groupBy((F.col("y") + p.is_years).alias("fold")).agg(
        *(f(F.when(c, F.col("date"))).alias(n) for n, f, c in (("is_lo", F.min, inside), ("is_hi", F.max, inside), ("oos_lo", F.min, ~inside), ("oos_hi", F.max, ~inside))),
        F.count_if(inside).alias("n_is"),
        F.count_if(~inside).alias("n_oos"),
    )
    return out.where((F.col("n_is") > p.min_is_rows) & (F.col("n_oos") > p.min_oos_rows)).withColumn("selection_date", F.col("is_hi"))


def liquid(panel: DataFrame, windows: DataFrame, min_adv: float) -> DataFrame:
    """fold, symbol, adv: median dollar volume over each fold's in-sample window, if large enough."""
    rows = panel.join(F.broadcast(windows.select("fold", "is_lo", "is_hi")), F.col("date").between(F.col("is_lo"), F.col("is_hi")))
    return rows.groupBy("fold", "symbol").agg(F.median("dollar_volume").alias("adv")).where(F.col("adv") >= min_adv)


def rolling_eligibility(rets: DataFrame, window: int, min_adv: float) -> DataFrame:
    """adv (rolling median dollar volume) and eligible: enough of it, and a return at each of the last `window` sessions."""
    last = Window.partitionBy("symbol").orderBy("didx").rangeBetween(-(window - 1), 0)
    rets = rets.withColumn("adv", F.percentile("dollar_volume", F.lit(0.5)).over(last)).withColumn("n_ret", F.count("ret").over(last))
    return rets.withColumn("eligible", (F.col("n_ret") == window) & (F.col("adv") >= min_adv)).drop("n_ret")


def quantile_band(rows: DataFrame, column: str, low: float, high: float, by: str = "date") -> DataFrame:
    """The rows between two interpolated quantiles of their cross-section."""
    day = Window.partitionBy(by)
    banded = rows.withColumn("_lo", F.percentile(column, F.lit(low)).over(day)).withColumn("_hi", F.percentile(column, F.lit(high)).over(day))
    return banded.where(f"{column} BETWEEN _lo AND _hi").drop("_lo", "_hi")
