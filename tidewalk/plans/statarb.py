"""Cross-sectional residual study as a chain of keyed steps: dates in parallel, then names, dates, names, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factor, learn, panel, pnl, positions
from ..params import DAILY, Params


def sign_flipped(rets: DataFrame, seeds: DataFrame | int) -> DataFrame:
    """Null control: all returns of a date times one sign drawn by a hash of date and seed; gaps stay gaps."""
    rows = rets.join(F.broadcast(seeds)) if isinstance(seeds, DataFrame) else rets.withColumn("seed", F.lit(seeds))  # a row a seed
    sign = F.when(F.substring(F.md5(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("/"), F.col("seed").cast("string"))), 1, 1) < "8", 1).otherwise(-1)
    return rows.withColumn("ret", F.col("ret") * sign)


def scored(rets: DataFrame, members: DataFrame | None, p: Params = DAILY, n_factors: int | str | None = None) -> DataFrame:
    names = factor.processed(rets, members, p).cache()
    q = factor.loadings(names, rets, p, n_factors)
    return factor.pca_scores(names, rets, q, p).join(names.select("t", "date", "symbol", "adv", "i"), ["t", "symbol"]).withColumn("tradable", factor.tradable(p))


def next_residuals(scores: DataFrame, rets: DataFrame, intercept: bool = True) -> DataFrame:
    """Scores with r_next: the return after the date, less the frozen factors' (and the intercept, unless told not to)."""
    after = rets.select((F.col("didx") - 1).alias("t"), "symbol", F.col("ret").alias("_next"))
    joined = scores.join(after, ["t", "symbol"], "left")
    parts = joined.select("t", F.posexplode("q").alias("j", "w"), F.coalesce("_next", F.lit(0.0)).alias("_r")).groupBy("t", "j").agg(F.sum(F.col("w") * F.col("_r")).alias("f"))
    moves = parts.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "f"))), lambda x: x["f"]).alias("_f"))  # a row a date
    joined = joined.join(F.broadcast(moves), "t", "left")
    explained = F.aggregate(F.zip_with(F.slice("beta", 2, 10_000), "_f", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    const = F.element_at("beta", 1) if intercept else F.lit(0.0)
    return joined.withColumn("r_next", F.col("_next") - const - explained).drop("_next", "_f")


def run(
    rets: DataFrame,
    members: DataFrame | None = None,
    p: Params = DAILY,
    *,
    n_factors: int | str | None = None,
    adv_quantile: tuple[float, float] | None = None,
    rule: str = "bands",
    mu_mode: str = "ou",
    mu_table: DataFrame | None = None,
    signal_table: DataFrame | None = None,
    risk_scale: bool = False,
) -> DataFrame:
    """date (of the return), gross, turnover, net, n_names, n_pos, n_factors, gross_exposure.

    rule: 'bands' (entry and exit levels), 'quantile', or 'optimal' (cost-aware); mu_mode: 'ou' or 'empirical'.
    signal_table (date, symbol, signal) replaces the score, mu_table (date, symbol, mu) the expected return.
    """
    rets = rets.cache()
    rows = scored(rets, members, p, n_factors).cache()  # every later step reads the scores
    if adv_quantile:
        inside = panel.quantile_band(rows, "adv", *adv_quantile).select("t", "symbol", F.lit(True).alias("_in"))
        rows = rows.join(inside, ["t", "symbol"], "left").withColumn("tradable", F.col("tradable") & F.coalesce("_in", F.lit(False))).drop("_in")
    mu = None
    if mu_mode == "empirical":
        with_next = next_residuals(rows, rets)
        rows, mu = positions.empirical_mu(with_next.withColumn("t", F.col("i")), p).withColumn("t", F.col("i") + max(p.pca_window, p.reg_window) + 1), "mu"
    if mu_table is not None:
        rows, mu = positions.external_mu(rows, mu_table), "mu"
    if signal_table is not None:
        rows = positions.external_signal(rows.join(signal_table, ["date", "symbol"], "left"), "signal").withColumn("tradable", F.col("tradable") & F.col("s_score").isNotNull())
    names = rets.select("symbol").distinct()
    n_symbols = names.count()
    dates = rows.select("t", "date").distinct()
    grid = dates.join(F.broadcast(names)) if n_symbols else dates  # dates x symbols, the panel itself
    lean = rows.drop("resid")
    if rule == "quantile":
        placed = positions.quantile_positions(lean.withColumn("signal", -F.col("s_score")), "signal", p, least=min(20, p.min_names))
    else:
        every = grid.join(lean, ["t", "date", "symbol"], "left").withColumn("present", F.col("b").isNotNull() | F.col("q").isNotNull())
        every = every.withColumn("tradable", F.coalesce("tradable", F.lit(False)))
        picked = every.select("t", "date", "symbol", "s_score", "b", "sigma_eq", "sigma_step", "resid_sd", "tradable", "present", *([mu] if mu else []))
        placed = positions.optimal_positions(picked, p, mu=mu) if rule == "optimal" else positions.band_positions(picked, p)
        placed = placed.where("present")
    sized = positions.inverse_risk(placed, "resid_sd") if risk_scale and rule != "optimal" else placed.withColumn("sized", F.col("pos"))
    flat = lean.select("date", "symbol", F.posexplode("q").alias("factor", "q"), "beta").select("date", "symbol", "factor", "q", F.element_at("beta", F.col("factor") + 2).alias("beta"))
    weights = positions.book_weights(sized.select("date", "symbol", "sized"), flat, normalise=rule != "optimal")
    weights = grid.select("date", "symbol").join(weights, ["date", "symbol"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    if p.no_trade_band > 0:
        weights = positions.no_trade_band(weights, p.no_trade_band, n_symbols).select("date", "symbol", F.col("held").alias("w"))
    calendar = rets.select("date", "didx").distinct()
    after = rets.select((F.col("didx") - 1).alias("didx"), "symbol", F.col("ret").alias("r_next")).join(F.broadcast(calendar), "didx").select("date", "symbol", "r_next")
    book = pnl.book_pnl(weights, after, p.cost_bps).drop("n_pos")
    counts = placed.groupBy("date").agg(F.count("*").alias("n_names"), F.count_if(F.col("pos") != 0).alias("n_pos"))
    factors = lean.groupBy("date").agg(F.max(F.size("q")).alias("n_factors"))
    nexts = calendar.select((F.col("didx") - 1).alias("didx"), F.col("date").alias("earned")).join(calendar, "didx").select("date", "earned")
    out = book.join(counts, "date").join(factors, "date").join(F.broadcast(nexts), "date")
    return out.select(F.col("earned").alias("date"), "gross", "turnover", "net", "n_names", "n_pos", "n_factors", "gross_exposure")


def learned(rets: DataFrame, predictions: DataFrame, p: Params = DAILY, *, span: int = 1, members: DataFrame | None = None, **rules) -> DataFrame:
    """The book of a learned signal: predictions (date, symbol, pred) averaged over seeds, smoothed if span > 1, in place of the score."""
    signal = learn.seed_average(predictions).withColumnRenamed("pred", "signal")
    if span > 1:
        days = signal.join(F.broadcast(rets.select("date", "didx").distinct()), "date")  # a row a session
        signal = days.select("date", "symbol", learn.smoothed("signal", span).alias("signal"))
    return run(rets, members, p, signal_table=signal.cache(), **rules)  # the networks run once, the book reads them often
