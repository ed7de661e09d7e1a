"""Planted parameters, identities, causality and boundaries of the estimators and rules."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewalk.operators import multitest, pairs, panel, pnl, positions, universe
from tidewalk.params import DAILY
from tidewalk.plans import pairs_book
from tidewalk.sources import files, panels

RNG = 20260819


def ou(rng, n, life, sigma=0.01):
    phi, s, out = math.exp(-math.log(2) / life), 0.0, []
    for e in rng.normal(0, sigma, n):
        s = phi * s + e
        out.append(s)
    return np.array(out)


def frame(spark, columns):
    names = list(columns)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in zip(*(np.asarray(columns[c]).tolist() for c in names), strict=True)]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def paths(spark):
    rng = np.random.default_rng(RNG)
    rows = {"life": [], "path": [], "date": [], "s": []}
    for life in (5, 15, 40):
        for path in range(12):
            for t, v in enumerate(ou(rng, 2500, life)):
                for k, x in zip(rows, (life, path, t, float(v)), strict=True):
                    rows[k].append(x)
    return frame(spark, rows).cache()


def test_half_life_recovers_planted_values(paths):
    out = pairs.half_life(paths, ["life", "path"]).groupBy("life").agg(F.avg("half_life").alias("m")).collect()
    for r in out:
        assert abs(r.m - r.life) < 0.2 * r.life


def test_ou_half_life_is_the_same(paths):
    a = pairs.half_life(paths, ["life", "path"]).join(pairs.ou_params(paths, ["life", "path"]).withColumnRenamed("half_life", "h2"), ["life", "path"])
    assert a.agg(F.max(F.abs(F.col("half_life") - F.col("h2")))).first()[0] < 1e-9


def test_slopes_of_a_swapped_pair(spark):
    """Total least squares is symmetric; the two ordinary slopes multiply to the squared correlation, and bracket it."""
    rng = np.random.default_rng(RNG + 1)
    x = rng.normal(3, 0.4, (5, 260))
    y = rng.uniform(0.3, 2.5, (5, 1)) * x + rng.normal(0, 0.2, (5, 260))
    rows = frame(spark, {"k": np.repeat(range(5), 260), "date": list(range(260)) * 5, "la": y.ravel(), "lb": x.ravel()})
    swapped = rows.select("k", "date", F.col("lb").alias("la"), F.col("la").alias("lb"))
    slopes = lambda fit: [{r.k: r.beta for r in fit(z, ["k"]).collect()} for z in (rows, swapped)]
    (t1, t2), (o1, o2) = slopes(pairs.hedge_tls), slopes(pairs.hedge_ols)
    for k in range(5):
        assert abs(t1[k] * t2[k] - 1) < 1e-9 and o1[k] < t1[k] < 1 / o2[k]
        assert abs(o1[k] * o2[k] - np.corrcoef(x[k], y[k])[0, 1] ** 2) < 1e-9


def test_residual_deviation_takes_two_degrees_of_freedom(spark):
    rng = np.random.default_rng(RNG + 2)
    x = np.cumsum(rng.normal(0, 0.02, 130))
    y = 0.7 * x + 1 + rng.normal(0, 0.05, 130)
    got = pairs.engle_granger(frame(spark, {"k": [1] * 130, "date": range(130), "la": y, "lb": x}), ["k"]).first()
    rest = y - np.polyval(np.polyfit(x, y, 1), x)
    assert got.resid_std == pytest.approx(np.std(rest, ddof=2))


def test_half_life_of_random_walks_is_long_and_grows_with_the_window(spark):
    rng, rows = np.random.default_rng(RNG + 3), []
    for k in range(120):
        walk = np.cumsum(rng.normal(0, 0.01, 900))
        rows += [(n, k, i, float(v)) for n in (200, 900) for i, v in enumerate(walk[:n])]
    out = pairs.half_life(spark.createDataFrame(rows, "n int, k int, date int, s double").withColumnRenamed("n", "size"), ["size", "k"]).where("half_life IS NOT NULL")
    mid = {r.size: r.m for r in out.groupBy("size").agg(F.median("half_life").alias("m")).collect()}
    assert 20 < mid[200] < mid[900] and mid[900] > 60 and out.where("NOT isnan(half_life) AND half_life < 1e7").count() >= 200


def test_z_scores_use_their_own_row_and_frozen_ones_the_past_only(spark):
    rng = np.random.default_rng(RNG + 4)
    s = ou(rng, 400, 30)
    rows = frame(spark, {"k": [1] * 400, "date": range(400), "s": s})
    z = [r.z for r in rows.withColumn("z", pairs.rolling_z("s", ["k"], "date", 40)).orderBy("date").collect()]
    for i in (39, 200, 399):
        window = s[i - 39 : i + 1]
        assert z[i] == pytest.approx((s[i] - window.mean()) / window.std(ddof=1))
    # a spread away from its mean for longer than the window looks ordinary to the rolling score, not to the frozen one
    shifted = np.concatenate([s[:200], s[200:] + 8 * s[:200].std()])
    rows = frame(spark, {"k": [1] * 400, "date": range(400), "s": shifted})
    frozen = pairs.calibrate(rows.where("date < 200"), ["k"])
    late = rows.withColumn("rolled", pairs.rolling_z("s", ["k"], "date", 40)).join(frozen, "k").withColumn("z", pairs.frozen_z()).where("date >= 260")
    far = late.agg(F.avg((F.abs("z") > 2).cast("int")).alias("frozen"), F.avg((F.abs("rolled") > 2).cast("int")).alias("rolled")).first()
    assert far.frozen > 0.95 > 0.5 > far.rolled


def test_engle_granger_power_size_and_gaps(spark):
    rng = np.random.default_rng(RNG)
    lb = np.cumsum(rng.normal(0, 0.012, 750))
    la = 1.3 * lb + ou(rng, 750, 12) + 2
    la[50:60] = np.nan
    rows = frame(spark, {"k": [0] * 750, "date": range(750), "la": la, "lb": lb}).where("la IS NOT NULL")
    hit = pairs.engle_granger(rows, ["k"]).first()
    assert hit.pvalue < 0.01 and abs(hit.beta - 1.3) < 0.15 and 5 < hit.half_life < 30 and hit.n_obs == 740
    cols = {"k": [], "date": [], "la": [], "lb": []}
    for k in range(150):
        for t, (x, y) in enumerate(np.cumsum(rng.normal(0, 0.012, (300, 2)), axis=0)):
            for c, v in zip(cols, (k, t, float(x), float(y)), strict=True):
                cols[c].append(v)
    null = pairs.engle_granger(frame(spark, cols), ["k"])
    assert null.where("pvalue < 0.05").count() / 150 < 0.11


def test_rolling_z_never_looks_ahead(spark):
    s = ou(np.random.default_rng(RNG), 300, 15)
    moved = s.copy()
    moved[200:] += 10
    z = [
        [r.z for r in frame(spark, {"k": [1] * 300, "date": range(300), "s": x}).withColumn("z", pairs.rolling_z("s", ["k"], "date", 60)).orderBy("date").collect()] for x in (s, moved)
    ]
    assert z[0][:200] == z[1][:200] and z[0][:59] == [None] * 59 and z[0][200:] != z[1][200:]


def test_quality_bounds_are_those_of_the_parameters(spark):
    p, eps = DAILY, 1e-9
    good = {"half_life": (p.half_life_min + p.half_life_max) / 2, "beta": (p.beta_min + p.beta_max) / 2, "n_obs": p.min_obs}
    edges = [("half_life", p.half_life_min, -eps), ("half_life", p.half_life_max, eps), ("beta", p.beta_min, -eps), ("beta", p.beta_max, eps), ("n_obs", p.min_obs, -1)]
    cases = [(good, True)] + [(good | {c: None}, False) for c in ("half_life", "beta")] + [(good | {"beta": -good["beta"]}, False)]
    for column, edge, step in edges:
        cases += [(good | {column: edge}, True), (good | {column: edge + step}, False)]
    rows = spark.createDataFrame([(i, c["half_life"], c["beta"], c["n_obs"]) for i, (c, _) in enumerate(cases)], "i int, half_life double, beta double, n_obs long")
    got = {r.i: r.q for r in rows.select("i", pairs.passes_quality().alias("q")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_degenerate_sigma_gives_no_score(spark):
    rows = spark.range(10).select(F.col("id").cast("double").alias("s"), F.lit(0.0).alias("mu"), F.lit(0.0).alias("sigma"))
    assert rows.where(pairs.frozen_z().isNotNull()).count() == 0


def test_corrections(spark):
    def run(p, alpha):
        rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(p)], "f int, i int, pvalue double")
        return sorted(multitest.flags(rows, ["f"], ["i"], alpha).collect(), key=lambda r: r.i)

    assert [r.bonferroni for r in run([0.004, 0.006, 0.5], 0.015)] == [True, False, False]
    assert [r.bh for r in run([0.001, 0.02, 0.025, 0.9], 0.05)] == [True, True, True, False]
    p = np.random.default_rng(0).random(200) ** 3
    out = run(p, 0.05)
    assert sum(r.bh for r in out) >= sum(r.bonferroni for r in out) and sum(r.by for r in out) <= sum(r.bh for r in out) <= sum(r.naive for r in out)
    assert multitest.flags(spark.createDataFrame([], "f int, i int, pvalue double"), ["f"], ["i"]).count() == 0


def test_hysteresis_equals_a_simulation():
    """State by state: flat, long or short, and barred after a stop or a break until |z| comes back inside the exit."""
    rng = np.random.default_rng(RNG + 5)
    for _ in range(60):
        z = np.cumsum(rng.normal(0, 0.9, 120)) * 0.7
        z[rng.random(120) < 0.05] = np.nan
        broken = rng.random(120) < 0.06
        side, barred, want = 0, False, []
        for x, b in zip(z, broken, strict=True):
            if np.isnan(x):
                side = 0
            elif b:
                side, barred = 0, True
            elif side:
                barred = barred or abs(x) >= 4
                side = 0 if abs(x) >= 4 or abs(x) <= 0.5 else side
            elif barred:
                barred = abs(x) > 0.5
            else:
                side = -int(np.sign(x)) if abs(x) >= 2 else 0
            want.append(side)
        assert positions.hysteresis(z, broken, 2, 0.5, 4).tolist() == want


def test_pair_pnl_is_yesterdays_position_over_gross_one(spark):
    rng = np.random.default_rng(RNG + 6)
    pos, ra, rb, beta = rng.integers(-1, 2, 50).astype(float), rng.normal(0, 0.02, 50), rng.normal(0, 0.02, 50), 1.7
    rows = spark.createDataFrame([(1, i, float(p), float(x), float(y), beta) for i, (p, x, y) in enumerate(zip(pos, ra, rb, strict=True))], "k int, date int, pos double, ra double, rb double, beta double")
    got = pnl.pair_pnl(rows, ["k"], 0.0).orderBy("date").collect()
    held = np.concatenate([[0], pos[:-1]])
    assert np.allclose([r.gross for r in got], held * (ra - beta * rb) / (1 + beta))
    assert np.allclose([r.turnover for r in got], np.abs(np.diff(np.concatenate([[0], pos]))))


def test_gaps_make_returns_null(spark):
    rows = [("A", "2020-01-01", 1.0), ("A", "2020-01-03", 2.0), ("A", "2020-01-04", 4.0), ("B", "2020-01-01", 5.0), ("B", "2020-01-02", 5.0)]
    prices = spark.createDataFrame(rows, "symbol string, date string, close double").withColumn("date", F.to_date("date")).withColumn("dollar_volume", F.lit(1.0))
    got = {(r.symbol, str(r.date)): r.ret for r in panel.returns(prices).collect()}
    assert got["A", "2020-01-03"] is None and got["A", "2020-01-04"] == 1.0


def test_folds_roll_a_year_and_do_not_overlap(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2014-01-01', DATE'2026-06-30', INTERVAL 1 DAY)) AS date").where("weekday(date) < 5")
    prices = days.withColumn("symbol", F.lit("A")).withColumn("close", F.lit(1.0)).withColumn("dollar_volume", F.lit(1.0))
    out = panel.folds(prices, DAILY).orderBy("fold").collect()
    assert len(out) >= 8 and all(r.is_hi < r.oos_lo and r.selection_date <= r.oos_lo for r in out)
    assert all(b.fold - a.fold == 1 and b.oos_lo > a.oos_hi and b.is_lo > a.is_lo for a, b in zip(out, out[1:], strict=False))


def test_liquidity_ignores_later_data_and_small_folds_have_no_pairs(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2014-01-01', DATE'2018-12-31', INTERVAL 1 DAY)) AS date").where("weekday(date) < 5")
    p = replace(DAILY, first_year=2014, last_year=2018, min_adv=100.0)
    names = spark.createDataFrame([(f"n{i}",) for i in range(6)], "symbol string")
    prices = days.crossJoin(names).withColumn("close", F.lit(1.0)).withColumn("dollar_volume", F.when((F.col("symbol") == "n5") & (F.year("date") < 2017), 1.0).otherwise(1000.0))
    windows = panel.folds(prices, p)
    members = lambda z, q: {(r.fold, r.symbol) for r in pairs_book.fold_members(z, None, windows, q).collect()}
    first = min(r.fold for r in windows.collect())
    later = prices.withColumn("dollar_volume", F.when(F.year("date") >= 2017, 0.0).otherwise(F.col("dollar_volume")))
    assert {s for f, s in members(prices, p) if f == first} == {f"n{i}" for i in range(5)}
    assert {x for x in members(later, p) if x[0] == first} == {x for x in members(prices, p) if x[0] == first}
    assert not [x for x in members(prices, replace(p, min_fold_names=6)) if x[0] == first]


def test_tickers_and_constituents(spark):
    dirty = {"abc": "ABC", " x.y\n": "X-Y", "q[12]": "Q", "lo ng": "LONG", "seven77": "SEVEN77"}
    raw = spark.createDataFrame(list(dirty.items()), "raw string, want string")
    assert raw.where(universe.normalise_ticker(F.col("raw")) != F.col("want")).count() == 0
    page = lambda head, rows: "<p>x<table><tr><td>1</td></tr></table><table><tr>" + "".join(f"<th>{h}" + "</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    head = ["Company", "GICS Sub-Industry", "Sector", "Symbol", "Ticker"]
    rows = [(f"N{i}", "sub", "A &amp; B", f"t{i}.x", "no") for i in range(7)]
    assert files.constituents(page(head, rows), 6) == [(f"t{i}.x", f"N{i}", "A & B", "sub") for i in range(7)]
    for bad in (page(head, rows[:6]), page(["Symbol", "Name"], [("a", "b")] * 9), "", "<table></table>"):  # six rows and a header are not over six
        with pytest.raises(LookupError):
            files.constituents(bad, 6)
    pages = spark.createDataFrame([(1, page(head, rows + [("L", "s", "S", "toolong", "x")])), (2, "no table"), (3, None)], "page_id long, html string")
    out = files.html_constituents(pages, 6)
    assert sorted((r.page_id, r.ticker) for r in out.collect()) == [(1, f"T{i}-X") for i in range(7)]
    with pytest.raises(Exception, match="no table of constituents"):
        files.html_constituents(pages, 6, strict=True).count()
    snaps = [r.snapshot for r in panels.snapshot_dates(spark, "2011-04-01", "2016-10-01", 6).collect()]
    assert len(snaps) == 12 and {s.month for s in snaps} == {4, 10} and snaps == sorted(set(snaps))


def test_markdown_reports(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").orderBy("a")
    assert files.markdown(rows).splitlines() == ["| a | b |", "| --- | --- |", "| 1 |  |", "| 2 | x |"]


def test_flagship_has_rows(spark):
    from tidewalk import registry

    out = registry.flagship(spark, "/root/testdata/sf0.001").collect()
    assert len(out) > 3 and {r.method for r in out} <= set(multitest.METHODS)
