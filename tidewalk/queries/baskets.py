"""Johansen baskets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import baskets, panel
from ..params import WEEKLY
from ..plans import basket_book
from ..registry import query
from . import sql as Q
from .pairs import rounded
from .panels import weekly

#: Groups that are drawn of all, the sample size of the studies.
MOST = 1_200
P = replace(WEEKLY, half_life_min=0.0, half_life_max=60.0)
GROUPS = """sy AS (SELECT DISTINCT symbol FROM panel),
gr AS (SELECT x.symbol || '/' || y.symbol || '/' || z.symbol AS label FROM sy x JOIN sy y ON x.symbol < y.symbol JOIN sy z ON y.symbol < z.symbol)"""


def screened(spark, sf_dir):
    prices = panel.returns(weekly(spark, sf_dir)).withColumn("fold", F.lit(0))
    return prices, baskets.screen(prices, baskets.groups(prices, 3, MOST, 7), ["fold"], least=100)


@query("j1_trace_rank")
def j1(spark, sf_dir):
    return rounded(screened(spark, sf_dir)[1].select("label", "rank", "trace0", "cv95_0", "excess", "n_obs"), "trace0", "excess", digits=4)


@query("j2_basket_weights")
def j2(spark, sf_dir):
    return screened(spark, sf_dir)[1].where("rank >= 1").select("label", F.explode("weights").alias("symbol", "w"))


@query(
    "j3_basket_spread", Q.PANEL,
    "SELECT 'b' AS label, date, round(sum(CASE symbol WHEN 'Brand#11' THEN 0.5 WHEN 'Brand#12' THEN -0.3 ELSE -0.2 END * ln(close)), 7) + 0.0 AS s FROM panel WHERE symbol IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY date",
)
def j3(spark, sf_dir):
    prices = panel.returns(weekly(spark, sf_dir))
    one = spark.range(1).select(F.lit("b").alias("label"), F.create_map(*map(F.lit, ("Brand#11", 0.5, "Brand#12", -0.3, "Brand#13", -0.2))).alias("weights"))
    return rounded(baskets.spread(prices, one, []), "s", digits=7)


@query("j4_groups", Q.PANEL, GROUPS, "SELECT label, (SELECT count(*) FROM gr) AS n_total FROM gr ORDER BY md5(label || '/7'), label LIMIT 1200")
def j4(spark, sf_dir):
    return baskets.groups(weekly(spark, sf_dir), 3, MOST, 7).select("label", "n_total")


@query("j5_null_rejection_rate")
def j5(spark, sf_dir):
    return baskets.null_rejections(spark)


@query("j6_basket_book")
def j6(spark, sf_dir):
    return rounded(basket_book.book(weekly(spark, sf_dir), P, most=MOST, seed=7), "net", "turnover")
