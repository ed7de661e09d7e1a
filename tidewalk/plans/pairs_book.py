"""Walk-forward pairs study: screen and freeze on each in-sample window, trade the year after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import multitest, pairs, panel, pnl, positions, regime, universe
from ..params import DAILY, Params

PAIR = pairs.PAIR


def fold_members(prices: DataFrame, membership: DataFrame | None, windows: DataFrame, p: Params = DAILY) -> DataFrame:
    """fold, symbol: members at the selection date that were liquid in sample; a fold of under five has none."""
    names = panel.liquid(prices, windows, p.min_adv).select("fold", "symbol")
    if membership is not None:
        picked = windows.select("fold", F.col("selection_date").alias("date"))
        members = universe.members_as_of(picked, membership).join(F.broadcast(picked), "date").select("fold", "symbol")  # a row a fold
        names = names.join(members, ["fold", "symbol"], "left_semi")
    enough = names.groupBy("fold").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_fold_names)
    return names.join(F.broadcast(enough.select("fold")), "fold")  # a row a fold


def scan(prices: DataFrame, p: Params = DAILY, membership: DataFrame | None = None) -> DataFrame:
    """All pairs of all folds with test results, quality, and one flag a correction."""
    windows = panel.folds(prices, p)
    members = fold_members(prices, membership, windows, p)
    tested = pairs.screen(panel.returns(prices), windows, p, members)
    return multitest.flags(tested, ["fold"], ["a", "b"], p.alpha)


def legs(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """fold, a, b, date, la, lb, ra, rb and the pair's own columns for the chosen pairs only."""
    side = lambda name: rows.select("fold", "date", F.col("symbol").alias(name), F.col("log_px").alias(f"l{name}"), F.col("ret").alias(f"r{name}"))
    return chosen.join(side("a"), ["fold", "a"]).join(side("b"), ["fold", "b", "date"])


def traded(prices: DataFrame, scanned: DataFrame, p: Params = DAILY, use_regime: bool = True) -> DataFrame:
    """Out-of-sample rows of every selected pair, each computed once whatever methods chose it, with P&L."""
    windows = panel.folds(prices, p)
    rets = panel.returns(prices).cache()  # read by both windows of both legs
    chosen = scanned.where(F.col("quality") & F.expr(" OR ".join(multitest.METHODS))).cache()  # the screen runs once
    history = windows.withColumn("ext_lo", F.date_sub("oos_lo", p.regime_history_days))
    inside = legs(pairs.fold_rows(rets, windows, "is_lo", "is_hi"), chosen)
    frozen = pairs.calibrate(inside.withColumn("s", pairs.spread()), PAIR)
    rows = legs(pairs.fold_rows(rets, history, "ext_lo", "oos_hi"), chosen).join(frozen, PAIR).withColumn("s", pairs.spread())
    rows = rows.withColumn("z", pairs.frozen_z())
    rows = regime.regime_flags(rows, PAIR, p) if use_regime else rows.withColumn("broken", F.lit(False))
    oos = rows.join(F.broadcast(windows.select("fold", "oos_lo")), "fold").where("date >= oos_lo").drop("oos_lo")
    keep = ["date", "z", "ra", "rb", "beta", "broken", *multitest.METHODS]
    return pnl.pair_pnl(positions.pair_positions(oos.select(*PAIR, *keep), PAIR, p), PAIR, p.cost_bps)


def books(rows: DataFrame) -> DataFrame:
    """method, fold, date and the equal-weight book over the pairs that the method selected."""
    methods = F.explode(F.filter(F.array(*(F.when(F.col(m), F.lit(m)) for m in multitest.METHODS)), lambda m: m.isNotNull()))
    return pnl.equal_weight_book(rows.withColumn("method", methods), ["method", "fold", "date"])


def walk_forward(prices: DataFrame, p: Params = DAILY, membership: DataFrame | None = None, use_regime: bool = True) -> DataFrame:
    """method, fold, date, gross, cost, net, turnover, broken_share, n_pairs: all stitched curves."""
    prices = prices.cache()
    return books(traded(prices, scan(prices, p, membership), p, use_regime))
