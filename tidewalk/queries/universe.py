"""Point-in-time universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import universe as V
from ..params import WEEKLY
from ..registry import query
from ..sources import panels
from . import sql as Q
from .panels import weekly

START, END = "1995-07-01", "2001-07-01"
#: A panel in which some symbols lose history, so that the identity check has every outcome.
CUT = """cut AS (SELECT * FROM panel WHERE NOT (substr(symbol, 8, 1) = '1') AND NOT (substr(symbol, 8, 1) = '2' AND date < DATE '2000-01-01')
  AND NOT (substr(symbol, 8, 1) = '3' AND date > DATE '1995-09-01'))"""
CHECK = """ids AS (SELECT w.symbol, memb_first, memb_last, n_snapshots, px_first, px_last, CAST(memb_last + INTERVAL 6 MONTH AS DATE) AS until FROM windows w
  LEFT JOIN (SELECT symbol, min(date) AS px_first, max(date) AS px_last FROM cut GROUP BY symbol) USING (symbol)),
raw AS (SELECT *, CASE WHEN px_first IS NULL THEN 0.0 ELSE greatest(date_diff('day', greatest(px_first, memb_first), least(px_last, until)), 0)
  / date_diff('day', memb_first, until) END AS f FROM ids),
checked AS (SELECT symbol, memb_first, memb_last, n_snapshots, px_first, px_last, round(f, 3) AS overlap_frac,
  CASE WHEN px_first IS NULL THEN 'NO_DATA' WHEN f < 0.05 THEN 'RECYCLED' WHEN f < 0.5 THEN 'SUSPECT' ELSE 'OK' END AS status FROM raw)"""


def members(spark, panel):
    return panels.members_by_volume(panel, panels.snapshot_dates(spark, START, END, 6))


def cut(panel):
    last = F.substring("symbol", 8, 1)
    return panel.where((last != "1") & ~((last == "2") & (F.col("date") < "2000-01-01")) & ~((last == "3") & (F.col("date") > "1995-09-01")))


@query(
    "u1_normalise_ticker",
    """SELECT s_suppkey, replace(replace(split_part(upper(trim(' ' || lower(s_name) || '.b[' || s_nationkey || '] ')), '[', 1), '.', '-'), ' ', '') AS ticker FROM supplier""",
)
def u1(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.lower("s_name"), F.lit(".b["), F.col("s_nationkey"), F.lit("] "))
    return panels.load(spark, sf_dir, "supplier").select("s_suppkey", V.normalise_ticker(raw).alias("ticker"))


@query("u2_valid_tickers", "SELECT o_orderkey, upper(o_orderpriority[1:8]) AS raw, replace(replace(upper(trim(o_orderpriority[1:8])), '.', '-'), ' ', '') AS ticker FROM orders WHERE length(replace(replace(upper(trim(o_orderpriority[1:8])), '.', '-'), ' ', '')) BETWEEN 1 AND 6")
def u2(spark, sf_dir):
    orders = panels.load(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.substring("o_orderpriority", 1, 8)).alias("raw"))
    return V.valid_tickers(orders, "raw")


@query("u3_snapshot_dates", Q.SNAPS, "SELECT snapshot FROM snaps")
def u3(spark, sf_dir):
    return panels.snapshot_dates(spark, START, END, 6)


@query(
    "u4_sector_membership", Q.PANEL, Q.SNAPS, Q.MEMBERS,
    "SELECT DISTINCT snapshot, symbol FROM membership WHERE 'sector ' || substr(symbol, 7, 1) = 'sector 2'",
)
def u4(spark, sf_dir):
    rows = members(spark, weekly(spark, sf_dir)).select("snapshot", F.col("symbol").alias("ticker"), F.concat(F.lit("Sector "), F.substring("symbol", 7, 1)).alias("sector"))
    return V.sector_members(rows, "SECTOR 2")


@query(
    "u5_snapshot_log", Q.PANEL, Q.SNAPS, Q.MEMBERS,
    "revs AS (SELECT snapshot, max(date) AS rev_date FROM snaps JOIN panel ON date <= snapshot GROUP BY snapshot)",
    """SELECT snapshot, rev_date, date_diff('day', rev_date, snapshot) AS lag_days, count(*) AS n_index, count(*) FILTER (WHERE substr(symbol, 7, 1) = '2') AS n_sector,
    string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE substr(symbol, 7, 1) = '2') AS tickers FROM membership JOIN revs USING (snapshot) GROUP BY snapshot, rev_date""",
)
def u5(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    index = members(spark, panel)
    revisions = V.revision_as_of(panels.snapshot_dates(spark, START, END, 6), panel.select(F.col("date").alias("rev_date"), F.lit(0).alias("rev_id")).distinct())
    log = V.snapshot_log(index.where(F.substring("symbol", 7, 1) == "2"), index, revisions.select("snapshot", "rev_date"))
    return log.withColumn("tickers", F.array_join("tickers", ",")).withColumn("lag_days", F.col("lag_days").cast("long"))


@query("u6_membership_windows", Q.PANEL, Q.SNAPS, Q.MEMBERS, Q.WINDOWS, "SELECT * FROM windows")
def u6(spark, sf_dir):
    return V.membership_windows(members(spark, weekly(spark, sf_dir)))


@query("u7_identity_check", Q.PANEL, Q.SNAPS, Q.MEMBERS, Q.WINDOWS, CUT, CHECK, "SELECT * FROM checked")
def u7(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    return V.identity_check(members(spark, panel), cut(panel), WEEKLY)


@query("u8_tradable_universe", Q.PANEL, Q.SNAPS, Q.MEMBERS, Q.WINDOWS, CUT, CHECK, "SELECT snapshot, symbol FROM membership WHERE symbol NOT IN (SELECT symbol FROM checked WHERE status <> 'OK')")
def u8(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    return V.tradable(members(spark, panel), cut(panel), WEEKLY)


@query(
    "u9_members_as_of", Q.PANEL, Q.SNAPS, Q.MEMBERS, Q.CALENDAR,
    "asof_snap AS (SELECT date, max(snapshot) AS snapshot FROM calendar JOIN (SELECT DISTINCT snapshot FROM membership) ON snapshot <= date GROUP BY date)",
    "SELECT date, symbol FROM asof_snap JOIN membership USING (snapshot)",
)
def u9(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    return V.members_as_of(P.calendar(panel), members(spark, panel))


@query("u10_listed", Q.PANEL, Q.CALENDAR, Q.LISTING, "SELECT date, symbol FROM calendar JOIN listing ON date >= onboard AND (delivery IS NULL OR date <= delivery)")
def u10(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    return V.listed(P.calendar(panel), panels.listings(panel))


@query(
    "u11_listing_check", Q.PANEL, CUT, Q.LISTING,
    """SELECT l.symbol, onboard, delivery, first_price, date_diff('day', onboard, first_price) AS gap_days, CASE WHEN first_price IS NULL THEN 'NO_DATA'
    WHEN date_diff('day', onboard, first_price) >= -5 THEN 'OK' ELSE 'PRE_ONBOARD_DATA' END AS status_check
    FROM listing l LEFT JOIN (SELECT symbol, min(date) AS first_price FROM cut GROUP BY symbol) USING (symbol)""",
)
def u11(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    return V.listing_check(panels.listings(panel), cut(panel), WEEKLY).withColumn("gap_days", F.col("gap_days").cast("long"))


@query(
    "u12_survivorship", Q.PANEL, Q.SNAPS, Q.MEMBERS, Q.WINDOWS, CUT, CHECK,
    "kept AS (SELECT snapshot, count(*) AS n FROM membership WHERE symbol IN (SELECT symbol FROM checked WHERE status = 'OK') GROUP BY snapshot)",
    """SELECT snapshot, count(*) AS n_raw, coalesce(n, 0) AS n_tradable, count(*) - coalesce(n, 0) AS n_lost, coalesce(n, 0) * (coalesce(n, 0) - 1) // 2 AS n_pairs
    FROM membership LEFT JOIN kept USING (snapshot) GROUP BY snapshot, n""",
)
def u12(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    raw = members(spark, panel)
    return V.survivorship(raw, V.tradable(raw, cut(panel), WEEKLY))


@query(
    "u13_symbol_sets", Q.PANEL, CUT,
    "SELECT symbol, 'lost' AS kind FROM (SELECT symbol FROM panel EXCEPT SELECT symbol FROM cut) UNION ALL SELECT symbol, 'both' FROM (SELECT symbol FROM panel INTERSECT SELECT symbol FROM cut)",
)
def u13(spark, sf_dir):
    panel = weekly(spark, sf_dir)
    a, b = panel.select("symbol"), cut(panel).select("symbol")
    return a.subtract(b).withColumn("kind", F.lit("lost")).union(a.intersect(b).withColumn("kind", F.lit("both")))
