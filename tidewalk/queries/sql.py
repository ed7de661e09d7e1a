"""Common table expressions of the SQL counterparts, over the raw tables."""

from ..functions.normal import mackinnon_p_sql

PANEL = """panel AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  round(sum(l_extendedprice), 2) / sum(l_quantity) AS close, round(sum(l_extendedprice), 2) AS dollar_volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
DAYS = PANEL.replace("'week'", "'day'")
CALENDAR = "calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS didx FROM (SELECT DISTINCT date FROM panel))"
RETS = """rets AS (SELECT symbol, date, didx, close, dollar_volume, ln(close) AS log_px,
  CASE WHEN didx - lag(didx) OVER w = 1 THEN close / lag(close) OVER w - 1 END AS ret
  FROM panel JOIN calendar USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY didx))"""
SNAPS = "snaps AS (SELECT CAST(unnest(generate_series(DATE '1995-07-01', DATE '2001-07-01', INTERVAL 6 MONTH)) AS DATE) AS snapshot)"
MEMBERS = """volume AS (SELECT snapshot, symbol, round(sum(dollar_volume), 2) AS volume FROM panel JOIN snaps
  ON date < snapshot AND date >= snapshot - INTERVAL 6 MONTH GROUP BY ALL),
membership AS (SELECT snapshot, symbol FROM (SELECT *, median(volume) OVER (PARTITION BY snapshot) AS middle FROM volume) WHERE volume >= middle)"""
WINDOWS = "windows AS (SELECT symbol, min(snapshot) AS memb_first, max(snapshot) AS memb_last, count(*) AS n_snapshots FROM membership GROUP BY symbol)"
SPANS = "spans AS (SELECT symbol, min(date) AS px_first, max(date) AS px_last FROM panel GROUP BY symbol)"
LISTING = """listing AS (SELECT symbol, CAST(min(date) + INTERVAL 21 DAY AS DATE) AS onboard,
  CASE WHEN max(date) < (SELECT max(date) FROM panel) THEN max(date) END AS delivery FROM panel GROUP BY symbol)"""
FOLDS = """folds AS (SELECT y + 3 AS fold, min(date) FILTER (WHERE year(date) < y + 3) AS is_lo, max(date) FILTER (WHERE year(date) < y + 3) AS is_hi,
  min(date) FILTER (WHERE year(date) >= y + 3) AS oos_lo, max(date) FILTER (WHERE year(date) >= y + 3) AS oos_hi,
  count(*) FILTER (WHERE year(date) < y + 3) AS n_is, count(*) FILTER (WHERE year(date) >= y + 3) AS n_oos
  FROM calendar JOIN (SELECT CAST(unnest(range(1995, 1999)) AS INTEGER) AS y) ON year(date) >= y AND year(date) < y + 4 GROUP BY y
  HAVING count(*) FILTER (WHERE year(date) < y + 3) > 100 AND count(*) FILTER (WHERE year(date) >= y + 3) > 30)"""
RATES = "rates AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, round(avg(o_totalprice), 4) AS tnx FROM orders GROUP BY 1)"
BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS close, max(value) AS high,
  min(value) AS low, round(sum(value), 2) AS volume FROM events WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts))"""
IS_ROWS = "is_rows AS (SELECT fold, symbol, date, ln(close) AS px FROM panel JOIN folds ON date BETWEEN is_lo AND is_hi)"


def pairs(name: str, rows: str) -> str:
    """Pair rows of a (fold, symbol, date, px) relation."""
    return f"{name} AS (SELECT x.fold, x.symbol AS a, y.symbol AS b, x.date, x.px AS la, y.px AS lb FROM {rows} x JOIN {rows} y ON x.fold = y.fold AND x.date = y.date AND x.symbol < y.symbol)"


def engle_granger(name: str, rows: str, keys: str = "fold, a, b", order: str = "date") -> str:
    """The two-step test of pair rows, in passes of its own."""
    return f"""{name}_fit AS (SELECT {keys}, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha, count(*) AS n_obs FROM {rows} GROUP BY ALL),
{name}_res AS (SELECT {keys}, {order}, la - beta * lb - alpha AS s FROM {rows} JOIN {name}_fit USING ({keys})),
{name}_lag AS (SELECT *, lag(s) OVER w AS u, s - lag(s) OVER w AS y, lag(s) OVER w - lag(s, 2) OVER w AS v FROM {name}_res WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{name}_sum AS (SELECT {keys}, count(v) AS m, count(y) AS n_steps, CASE WHEN count(*) > 2 THEN sqrt(sum(s * s) / (count(*) - 2)) END AS resid_std, regr_slope(y, u) AS slope, sum(u * u) FILTER (WHERE v IS NOT NULL) AS uu,
  sum(v * v) AS vv, sum(u * v) AS uv, sum(u * y) FILTER (WHERE v IS NOT NULL) AS uy, sum(v * y) AS vy, sum(y * y) FILTER (WHERE v IS NOT NULL) AS yy FROM {name}_lag GROUP BY ALL),
{name}_sol AS (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS gamma, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS delta FROM {name}_sum),
{name}_tst AS (SELECT *, gamma / sqrt((yy - gamma * uy - delta * vy) / (m - 2) * vv / (uu * vv - uv * uv)) AS tstat FROM {name}_sol),
{name} AS (SELECT {keys}, beta, alpha, n_obs, {mackinnon_p_sql('tstat')} AS pvalue, tstat,
  CASE WHEN n_steps >= 19 AND 1 + slope > 0 AND 1 + slope < 1 THEN -ln(2) / ln(1 + slope) END AS half_life, resid_std FROM {name}_fit JOIN {name}_tst USING ({keys}))"""


def positions(name: str, rows: str, keys: str = "fold, a, b") -> str:
    """Hysteresis positions of rows (keys, date, z, broken), one row after the other."""
    k = [x.strip() for x in keys.split(",")]
    same = " AND ".join(f"r.{x} = p.{x}" for x in k)
    cols = ", ".join(f"r.{x}" for x in k)
    return f"""{name}_num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i FROM {rows}),
{name} AS (SELECT {keys}, i, date, z, broken, CASE WHEN z IS NULL OR broken THEN 0.0 WHEN z <= -2 THEN 1.0 WHEN z >= 2 THEN -1.0 ELSE 0.0 END AS pos,
  CASE WHEN z IS NULL THEN false ELSE broken END AS barred FROM {name}_num WHERE i = 1
 UNION ALL SELECT {cols}, r.i, r.date, r.z, r.broken,
  CASE WHEN r.z IS NULL OR r.broken THEN 0.0 WHEN p.pos <> 0 THEN CASE WHEN abs(r.z) >= 4 OR abs(r.z) <= 0.5 THEN 0.0 ELSE p.pos END
   WHEN p.barred THEN 0.0 WHEN r.z <= -2 THEN 1.0 WHEN r.z >= 2 THEN -1.0 ELSE 0.0 END,
  CASE WHEN r.z IS NULL THEN p.barred WHEN r.broken THEN true WHEN p.pos <> 0 THEN p.barred OR abs(r.z) >= 4 WHEN p.barred THEN abs(r.z) > 0.5 ELSE false END
 FROM {name} p JOIN {name}_num r ON {same} AND r.i = p.i + 1)"""


def metrics(rows: str, keys: str, net: str = "net", turnover: str = "CAST(NULL AS DOUBLE)", per_year: int = 52) -> str:
    """One row of metrics a group, unrounded."""
    return f"""(WITH c AS (SELECT {keys}, date, {net} AS net, {turnover} AS turn, CASE WHEN {net} IS NOT NULL THEN sum({net}) OVER (PARTITION BY {keys} ORDER BY date) END AS curve FROM {rows}),
 d AS (SELECT *, curve - max(curve) OVER (PARTITION BY {keys} ORDER BY date) AS down FROM c),
 g AS (SELECT {keys}, count(net) AS days, avg(net) AS mean, stddev_samp(net) AS sd, min(down) AS dd,
  avg(CASE WHEN net <> 0 THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END) AS hit, sum(turn) AS turn FROM d GROUP BY {keys})
 SELECT {keys}, days, CASE WHEN sd > 0 THEN mean * {per_year} END AS ann_return, CASE WHEN sd > 0 THEN sd * sqrt({per_year}) END AS ann_vol,
  CASE WHEN sd > 0 THEN mean * {per_year} / (sd * sqrt({per_year})) END AS sharpe, CASE WHEN sd > 0 THEN dd END AS max_dd,
  CASE WHEN sd > 0 THEN hit END AS hit_rate, CASE WHEN sd > 0 THEN turn / (days / {per_year}.0) END AS turnover FROM g)"""
