"""Walk-forward baskets: screen in sample, trade the strongest out of sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import baskets, pairs, panel, positions
from ..params import DAILY, Params

KEYS = ["fold", "label"]


def book(prices: DataFrame, p: Params = DAILY, size: int = 3, most: int = 1200, top: int = 20, seed: int = 0) -> DataFrame:
    """fold, date, net, turnover, n_baskets: the equal-weight book of the baskets that mean-revert fast enough."""
    windows = panel.folds(prices, p)
    rets = panel.returns(prices)
    chosen = baskets.groups(prices, size, most, seed)
    inside = pairs.fold_rows(rets, windows, "is_lo", "is_hi")
    found = baskets.screen(inside, chosen, ["fold"], least=p.min_obs).where("rank >= 1")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("excess"), "label"))).where(F.col("k") <= top).drop("k")
    spreads = baskets.spread(inside, best, ["fold"])
    lives = pairs.half_life(spreads, KEYS).where(F.col("half_life").between(p.half_life_min, p.half_life_max)).select(*KEYS)
    frozen = pairs.calibrate(spreads.join(lives, KEYS, "left_semi"), KEYS)
    outside = pairs.fold_rows(rets, windows, "oos_lo", "oos_hi")
    rows = baskets.spread(outside, best, ["fold"]).join(frozen, KEYS).withColumn("z", pairs.frozen_z())
    rows = positions.pair_positions(rows.select(*KEYS, "date", "z"), KEYS, p)
    earned = baskets.spread(outside, best, ["fold"], "ret", "ret")
    gross = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, w: a + F.abs(w))
    before = F.coalesce(F.lag("pos").over(Window.partitionBy(*KEYS).orderBy("date")), F.lit(0.0))
    rows = rows.join(earned, [*KEYS, "date"]).join(best.select(*KEYS, gross.alias("gross")), KEYS).withColumn("before", before)
    rows = rows.withColumn("turnover", F.abs(F.col("pos") - F.col("before")) * F.col("gross"))
    net = F.col("before") * F.col("ret") - F.col("turnover") * p.cost_bps / 1e4
    return rows.withColumn("net", net).groupBy("fold", "date").agg(F.avg("net").alias("net"), F.avg("turnover").alias("turnover"), F.count("*").alias("n_baskets"))
