"""Date x symbol panels in long form from star-schema and event tables; an absent row means not traded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """symbol, date, close (volume-weighted price), dollar_volume of each brand and period."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", F.date_trunc(unit, "l_shipdate").cast("date").alias("date"))
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    value = F.round(F.sum("l_extendedprice"), 2)
    return lines.join(parts, "l_partkey").groupBy("symbol", "date").agg((value / F.sum("l_quantity")).alias("close"), value.alias("dollar_volume"))


def supplier_panel(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The same of each supplier; dense even in the smallest tables."""
    lines = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), "l_quantity", "l_extendedprice")
    value = F.round(F.sum("l_extendedprice"), 2)
    return lines.groupBy("symbol", "date").agg((value / F.sum("l_quantity")).alias("close"), value.alias("dollar_volume"))


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """symbol, ts, close (last value), high, low, volume of each event type and period; ties go to the larger event id."""
    events = load(spark, sf_dir, "events").where("value IS NOT NULL")
    last = F.max_by("value", F.struct("ts", "event_id"))
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(
        last.alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.round(F.sum("value"), 2).alias("volume")
    )


def rate_series(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """date, tnx: a rate that stands in for a yield."""
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy(F.date_trunc(unit, "o_orderdate").cast("date").alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("tnx"))


def snapshot_dates(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    step = F.expr(f"INTERVAL {int(months)} MONTH")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), step)).alias("snapshot"))


def members_by_volume(panel: DataFrame, snapshots: DataFrame, months: int = 6) -> DataFrame:
    """snapshot, symbol: symbols whose dollar volume over the months before is at least the cross-section's median."""
    recent = (F.col("date") < F.col("snapshot")) & (F.col("date") >= F.add_months("snapshot", -months))
    volume = panel.join(F.broadcast(snapshots), recent).groupBy("snapshot", "symbol").agg(F.round(F.sum("dollar_volume"), 2).alias("volume"))
    middle = volume.groupBy("snapshot").agg(F.median("volume").alias("middle"))
    return volume.join(middle, "snapshot").where("volume >= middle").select("snapshot", "symbol")


def listings(panel: DataFrame) -> DataFrame:
    """symbol, onboard, delivery (null for those still traded on the last date)."""
    spans = panel.groupBy("symbol").agg(F.min("date").alias("onboard"), F.max("date").alias("last"))
    end = panel.agg(F.max("date").alias("end"))
    return spans.join(F.broadcast(end)).select("symbol", F.date_add("onboard", 21).alias("onboard"), F.when(F.col("last") < F.col("end"), F.col("last")).alias("delivery"))
