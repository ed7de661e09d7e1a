"""Numerical kernels against independent forms: baskets, networks, eigenportfolios, stale betas, whole books."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tidewalk.operators import baskets, factor, learn
from tidewalk.params import DAILY, WEEKLY
from tidewalk.plans import statarb

RNG = 61


@pytest.mark.parametrize(("k", "lags"), [(2, 1), (3, 1), (4, 2)])
def test_trace_statistic_solves_the_generalised_eigenvalue_problem(k, lags):
    rng = np.random.default_rng(RNG + k)
    x = np.cumsum(rng.normal(0, 1, (400, k)), axis=0)
    x[:, 0] = 0.6 * x[:, -1] + rng.normal(0, 1, 400)
    trace, vectors = baskets.trace_test(x, lags)
    # residual moments by normal equations, eigenvalues of Skk^-1 Sk0 S00^-1 S0k without a Cholesky root
    z = x - x.mean(0)
    d = z[1:] - z[:-1]
    past = np.hstack([d[lags - j : len(d) - j] for j in range(1, lags + 1)])
    centre = lambda m: m - m.mean(0)
    past, now, level = centre(past), centre(d[lags:]), centre(z[lags:-1])
    drop = np.eye(len(past)) - past @ np.linalg.inv(past.T @ past) @ past.T
    r0, rk = drop @ now, drop @ level
    s00, skk, sk0 = r0.T @ r0, rk.T @ rk, rk.T @ r0
    product = np.linalg.inv(skk) @ sk0 @ np.linalg.inv(s00) @ sk0.T
    values = np.sort(np.linalg.eigvals(product).real)[::-1]
    want = [-len(now) * np.log(1 - values[i:]).sum() for i in range(k)]
    assert np.allclose(trace, want)
    assert np.allclose(product @ vectors, vectors * values, atol=1e-8)
    assert baskets.rank_of(trace) >= 1


def test_basket_books_and_weights(spark):
    rng, rows = np.random.default_rng(RNG), []
    walk = np.cumsum(rng.normal(0, 0.02, (300, 3)), axis=0) + 3
    walk[:, 2] = 0.5 * walk[:, 0] + 0.5 * walk[:, 1] + rng.normal(0, 0.01, 300)
    for i, r in enumerate(walk):
        rows += [(0, s, i, float(v)) for s, v in zip("ABC", r, strict=True)]
    prices = spark.createDataFrame(rows, "fold int, symbol string, date int, log_px double")
    one = baskets.screen(prices, baskets.groups(prices, 3), ["fold"], least=100).first()
    assert one["rank"] >= 1 and one.label == "A/B/C" and sum(map(abs, one.weights.values())) == pytest.approx(1, abs=1e-3)
    assert one.weights["A"] / one.weights["C"] == pytest.approx(-0.5, abs=0.1) and max(one.weights.values(), key=abs) > 0


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(RNG)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=30)
    net = learn.Network(4, 1, (6, 5), dropout=0.0)
    loss = lambda: ((net.forward(x)[0] - y) ** 2).mean()
    for p, g in zip(net.params, net.gradients(x, y), strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in range(0, len(flat), 3):
            at = flat[i]
            flat[i] = at + 1e-6
            up = loss()
            flat[i] = at - 1e-6
            down = loss()
            flat[i] = at
            assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_network_learns_and_ridge_equals_least_squares(spark):
    rng = np.random.default_rng(RNG)
    x = rng.normal(size=(900, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=900)
    part = ["train"] * 600 + ["val"] * 150 + ["test"] * 150
    frame = pd.DataFrame({"date": pd.Timestamp("2020-01-01").date(), "symbol": [f"s{i:03}" for i in range(900)], "test_year": 2020, "part": part, "y1": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    rows = spark.createDataFrame(frame).selectExpr("*", "cast(test_year AS int) AS ty").drop("test_year").withColumnRenamed("ty", "test_year")
    wide = learn.ridge(rows, ["a", "b", "c"], "y1", 0.0).toPandas().sort_values("symbol")
    design = np.column_stack([np.ones(900), x])
    want = design[750:] @ np.linalg.lstsq(design[:600], y[:600], rcond=None)[0]
    assert np.allclose(wide.pred.to_numpy(), want)
    net = learn.network(rows, ["a", "b", "c"], "y1", 2, 300).toPandas()
    by = net.groupby("seed").apply(lambda g: np.corrcoef(g.sort_values("symbol").pred, y[750:])[0, 1], include_groups=False)
    assert len(by) == 2 and by.min() > 0.9
    mean = learn.seed_average(spark.createDataFrame(net)).toPandas().set_index("symbol").pred
    assert np.allclose(mean, net.groupby("symbol").pred.mean().loc[mean.index])


def test_eigenportfolios_diagonalise_the_correlations():
    rng = np.random.default_rng(RNG)
    window = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12)) * 0.01
    q = factor.eigen_portfolios(window, 12)
    sd = window.std(axis=0, ddof=1)
    v, corr = q * sd[:, None], np.corrcoef(window, rowvar=False)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-9)
    inner = v.T @ corr @ v
    assert np.allclose(inner, np.diag(np.diag(inner)), atol=1e-9) and (np.diff(np.diag(inner)) <= 1e-9).all()
    assert np.trace(inner) == pytest.approx(12) and (v[np.abs(v).argmax(0), np.arange(12)] > 0).all()


P = replace(DAILY, pca_window=30, reg_window=20, pca_step=4, n_factors=2, min_names=5, factor_min_adv=0.0)


def returns_of(spark, n=70, names=8):
    rng = np.random.default_rng(RNG)
    common = rng.normal(0, 0.01, (n, 2))
    r = common @ rng.normal(size=(2, names)) + rng.normal(0, 0.01, (n, names))
    days = pd.bdate_range("2020-01-01", periods=n).date
    rows = [(f"n{j}", days[i], i, 1.0, 1e6, float(r[i, j])) for i in range(n) for j in range(names)]
    return r, spark.createDataFrame(rows, "symbol string, date date, didx long, close double, dollar_volume double, ret double")


@pytest.mark.parametrize("step", [1, 3])
def test_scores_equal_a_loop_over_dates(spark, step):
    r, rets = returns_of(spark)
    p = replace(P, beta_step=step)
    got = statarb.scored(rets, None, p).toPandas().sort_values(["t", "symbol"])
    start, n_days = max(p.pca_window, p.reg_window) + 1, len(r)
    assert sorted(got.t.unique()) == list(range(start, n_days - 1))
    q = beta = None
    for t in range(start, n_days - 1):
        if (t - start) % p.pca_step == 0:
            q = factor.eigen_portfolios(r[t - p.pca_window + 1 : t + 1], p.n_factors)
        own = r[t - p.reg_window + 1 : t + 1]
        design = np.column_stack([np.ones(p.reg_window), own @ q])
        if (t - start) % step == 0:
            beta = np.linalg.inv(design.T @ design) @ design.T @ own
        x = np.cumsum(own - design @ beta, axis=0)
        for j, row in enumerate(got[got.t == t].itertuples()):
            a, b = x[:-1, j], x[1:, j]
            slope, level = np.polyfit(a, b, 1)
            if not 0 < slope < 1:
                assert np.isnan(row.s_score)
                continue
            noise = ((b - level - slope * a) ** 2).sum() / (len(a) - 2)
            assert row.s_score == pytest.approx((x[-1, j] - level / (1 - slope)) / np.sqrt(noise / (1 - slope**2)), rel=1e-6, abs=1e-8)


def test_cross_sectional_book_equals_its_weights(spark):
    _, rets = returns_of(spark, 90, 10)
    out = statarb.run(rets, None, replace(P, cost_bps=10.0, s_open=0.5, half_life_days=1e9)).toPandas()
    assert len(out) > 20 and out.gross_exposure.between(0, 3).all() and out.date.is_unique and out.turnover.sum() > 0
    assert np.allclose(out.net, out.gross - out.turnover * 10.0 / 1e4)


def test_learned_book_takes_its_signal(spark):
    r, rets = returns_of(spark, 90, 30)
    rows = rets.where("didx > 31").selectExpr("date", "symbol", "double(crc32(binary(concat(symbol, date))) % 1000) AS pred")
    twice = rows.selectExpr("*", "0 AS seed").unionByName(rows.selectExpr("date", "symbol", "pred + 2 AS pred", "1 AS seed"))
    p = replace(P, min_names=20, half_life_days=1e9)
    a = statarb.learned(rets, twice, p, rule="quantile").toPandas().sort_values("date")
    b = statarb.run(rets, None, p, rule="quantile", signal_table=rows.withColumnRenamed("pred", "signal")).toPandas().sort_values("date")
    assert len(a) > 20 and np.allclose(a.gross, b.gross) and a.turnover.sum() > 0


def test_weekly_parameters_keep_the_daily_ones():
    assert WEEKLY.min_fold_names == DAILY.min_fold_names == 5 and DAILY.beta_step == 1
