"""Point-in-time universes: symbols, snapshots, identity checks, and as-of membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAILY, Params


def normalise_ticker(raw: Column) -> Column:
    """Trimmed, upper case, cut at a footnote bracket, dots as dashes, no spaces."""
    return F.replace(F.translate(F.substring_index(F.upper(F.regexp_replace(raw, r"^\s+|\s+$", "")), "[", 1), ".", "-"), F.lit(" "), F.lit(""))


def valid_tickers(rows: DataFrame, column: str) -> DataFrame:
    clean = rows.withColumn("ticker", normalise_ticker(F.col(column)))
    return clean.where(F.length("ticker").between(1, 6))


def sector_members(constituents: DataFrame, sector: str | None) -> DataFrame:
    """snapshot, symbol of one sector (any case), or of the whole index."""
    kept = constituents if sector is None else constituents.where(F.lower("sector") == sector.lower())
    return kept.select("snapshot", F.col("ticker").alias("symbol")).distinct()


def snapshot_log(membership: DataFrame, index: DataFrame, revisions: DataFrame) -> DataFrame:
    """snapshot, rev_date, lag_days, n_index, n_sector, tickers (sorted) of each snapshot."""
    sizes = index.groupBy("snapshot").agg(F.count("*").alias("n_index"))
    names = membership.groupBy("snapshot").agg(F.count("*").alias("n_sector"), F.sort_array(F.collect_list("symbol")).alias("tickers"))
    joined = revisions.join(sizes, "snapshot", "left").join(names, "snapshot", "left")
    return joined.select(
        "snapshot", "rev_date", F.datediff("snapshot", "rev_date").alias("lag_days"), F.coalesce("n_index", F.lit(0)).alias("n_index"), F.coalesce("n_sector", F.lit(0)).alias("n_sector"), "tickers"
    )


def revision_as_of(snapshots: DataFrame, revisions: DataFrame) -> DataFrame:
    """snapshot, rev_date, rev_id: for each snapshot the last revision at or before it."""
    met = revisions.join(F.broadcast(snapshots), F.col("rev_date") <= F.col("snapshot"))  # a row a snapshot
    return met.groupBy("snapshot").agg(F.max("rev_date").alias("rev_date"), F.max_by("rev_id", F.struct("rev_date", "rev_id")).alias("rev_id"))


def membership_windows(membership: DataFrame) -> DataFrame:
    return membership.groupBy("symbol").agg(F.min("snapshot").alias("memb_first"), F.max("snapshot").alias("memb_last"), F.count("*").alias("n_snapshots"))


def identity_check(membership: DataFrame, panel: DataFrame, p: Params = DAILY) -> DataFrame:
    """How far each member's prices cover its membership, and whether the symbol can be trusted."""
    spans = panel.where("close IS NOT NULL").groupBy("symbol").agg(F.min("date").alias("px_first"), F.max("date").alias("px_last"))
    rows = membership_windows(membership).join(spans, "symbol", "left")
    end = F.add_months("memb_last", p.snapshot_months)
    both = F.datediff(F.least("px_last", end), F.greatest("px_first", "memb_first"))
    raw = F.when(F.col("px_first").isNull(), 0.0).otherwise(F.greatest(both, F.lit(0)) / F.datediff(end, "memb_first"))
    status = F.when(F.col("px_first").isNull(), "NO_DATA").when(raw < p.recycled_overlap, "RECYCLED").when(raw < p.min_overlap, "SUSPECT").otherwise("OK")
    return rows.withColumn("overlap_frac", F.round(raw, 3)).withColumn("status", status)


def tradable(membership: DataFrame, panel: DataFrame, p: Params = DAILY) -> DataFrame:
    bad = identity_check(membership, panel, p).where("status <> 'OK'").select("symbol")
    return membership.join(bad, "symbol", "left_anti").select("snapshot", "symbol")


def intervals(membership: DataFrame) -> DataFrame:
    """symbol, snapshot, until: membership as half-open intervals between snapshots of the table."""
    order = Window.orderBy("snapshot")  # a row a snapshot
    nexts = membership.select("snapshot").distinct().withColumn("until", F.lead("snapshot").over(order))
    return membership.join(F.broadcast(nexts), "snapshot")


def members_as_of(dates: DataFrame, membership: DataFrame) -> DataFrame:
    """date, symbol: the members at the latest snapshot at or before each date."""
    nexts = intervals(membership).select("snapshot", "until").distinct()
    inside = (F.col("date") >= F.col("snapshot")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))
    dated = dates.select("date").distinct().join(F.broadcast(nexts), inside).select("date", "snapshot")
    return dated.join(membership, "snapshot").select("date", "symbol")


def listed(dates: DataFrame, listing: DataFrame) -> DataFrame:
    """date, symbol: between listing and delivery, both included."""
    inside = (F.col("date") >= F.col("onboard")) & (F.col("delivery").isNull() | (F.col("date") <= F.col("delivery")))
    return dates.select("date").distinct().join(listing, inside).select("date", "symbol")


def listing_check(listing: DataFrame, panel: DataFrame, p: Params = DAILY) -> DataFrame:
    """Declared listing against the first price: a price long before it means another contract."""
    first = panel.where("close IS NOT NULL").groupBy("symbol").agg(F.min("date").alias("first_price"))
    gap = F.datediff("first_price", "onboard")
    status = F.when(gap.isNull(), "NO_DATA").when(gap >= -p.listing_tolerance_days, "OK").otherwise("PRE_ONBOARD_DATA")
    return listing.join(first, "symbol", "left").withColumn("gap_days", gap).withColumn("status_check", status)


def survivorship(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Per snapshot: members before and after the identity check, lost slots, pairs left."""
    a = raw.groupBy("snapshot").agg(F.count("*").alias("n_raw"))
    b = kept.groupBy("snapshot").agg(F.count("*").alias("n_tradable"))
    n = F.coalesce("n_tradable", F.lit(0))
    return a.join(b, "snapshot", "left").select("snapshot", "n_raw", n.alias("n_tradable"), (F.col("n_raw") - n).alias("n_lost"), F.expr("coalesce(n_tradable, 0) * (coalesce(n_tradable, 0) - 1) div 2").alias("n_pairs"))
