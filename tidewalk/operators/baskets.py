"""Cointegrated baskets: Johansen's trace test by an Arrow kernel per group of names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 95 % critical values of the trace statistic for 1 to 5 remaining relations, constant case.
CRITICAL = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189)


def trace_test(levels: np.ndarray, lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Trace statistics for rank 0, 1, ... and the eigenvectors (columns, largest eigenvalue first)."""
    x = levels - levels.mean(axis=0)
    dx = np.diff(x, axis=0)
    past = np.column_stack([dx[lags - j : len(dx) - j] for j in range(1, lags + 1)])
    centred = [m - m.mean(axis=0) for m in (past, dx[lags:], x[lags:-1])]
    past, now, before = centred
    hat = np.linalg.lstsq(past, np.column_stack([now, before]), rcond=None)[0]
    rest = np.column_stack([now, before]) - past @ hat
    k, n = x.shape[1], len(now)
    r0, rk = rest[:, :k], rest[:, k:]
    s00, skk, sk0 = r0.T @ r0 / n, rk.T @ rk / n, rk.T @ r0 / n
    root = np.linalg.inv(np.linalg.cholesky(skk))
    values, vectors = np.linalg.eigh(root @ sk0 @ np.linalg.solve(s00, sk0.T) @ root.T)
    order = np.argsort(-values)
    values = np.clip(values[order], 0, 1 - 1e-12)
    return -n * np.cumsum(np.log1p(-values)[::-1])[::-1], (root.T @ vectors)[:, order]


def rank_of(trace: np.ndarray) -> int:
    above = trace > np.array(CRITICAL[: len(trace)])[::-1]
    return int(np.argmin(np.append(above, False)))


def groups(symbols: DataFrame, size: int = 3, most: int | None = None, seed: int = 0) -> DataFrame:
    """names (array, sorted), label, n_total: all groups of `size` symbols, or the first `most` by a hash."""
    one = symbols.select("symbol").distinct()
    sides = [one.select(F.col("symbol").alias(f"s{i}")) for i in range(size)]
    joined = reduce(lambda a, b: a.join(b, F.col(a.columns[-1]) < F.col(b.columns[0])), sides)
    made = joined.select(F.array(*(f"s{i}" for i in range(size))).alias("names")).withColumn("label", F.array_join("names", "/"))
    total = F.broadcast(made.agg(F.count("*").alias("n_total")))  # one row
    if most is not None:
        made = made.orderBy(F.md5(F.concat("label", F.lit(f"/{seed}"))), "label").limit(most)
    return made.join(total)


def _levels(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    return rows.pivot(index="date", columns="symbol", values="log_px").reindex(columns=names).dropna().to_numpy()


def screen(prices: DataFrame, chosen: DataFrame, keys: list[str], lags: int = 1, least: int = 500) -> DataFrame:
    """keys..., label, rank, trace0, cv95_0, excess, weights (map, gross 1), n_obs of each group with enough complete rows.

    prices: keys..., symbol, date, log_px. One group of names and one fold is a task's unit; its rows are bounded.
    """
    members = chosen.select("label", "names", F.explode("names").alias("symbol"))
    rows = prices.select(*keys, "symbol", "date", "log_px").join(F.broadcast(members) if chosen.count() <= 100_000 else members, "symbol")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = list(group["names"].iloc[0])
        x = _levels(group, names)
        if len(x) < max(least, 100) or len(names) < 2 or np.linalg.matrix_rank(x - x.mean(0)) < len(names):
            return pd.DataFrame(columns=[*keys, "label", "rank", "trace0", "cv95_0", "excess", "weights", "n_obs"])
        trace, vectors = trace_test(x, lags)
        rank, w = rank_of(trace), vectors[:, 0]
        w = w * np.sign(w[np.abs(w).argmax()]) / np.abs(w).sum()
        cv = CRITICAL[len(names) - 1]
        row = {k: [group[k].iloc[0]] for k in keys} | {
            "label": ["/".join(names)], "rank": [rank], "trace0": [trace[0]], "cv95_0": [cv], "excess": [trace[0] - cv],
            "weights": [{s: round(float(v), 4) for s, v in zip(names, w, strict=True)} if rank else None], "n_obs": [len(x)],
        }
        return pd.DataFrame(row)

    types = dict(prices.dtypes)
    head = "".join(f"{k} {types[k]}, " for k in keys)
    return rows.groupBy(*keys, "label").applyInPandas(run, head + "label string, rank int, trace0 double, cv95_0 double, excess double, weights map<string,double>, n_obs int")


def spread(prices: DataFrame, baskets: DataFrame, keys: list[str], value: str = "log_px", out: str = "s") -> DataFrame:
    """keys..., label, date and the weighted sum; a missing leg counts as 0."""
    legs = baskets.select(*keys, "label", F.explode("weights").alias("symbol", "w"))
    return prices.join(legs, [*keys, "symbol"]).groupBy(*keys, "label", "date").agg(F.sum(F.col("w") * F.coalesce(value, F.lit(0.0))).alias(out))


def null_rejections(spark, n_series: int = 3, n_obs: int = 750, n_sim: int = 300, lags: int = 1, seed: int = 0) -> DataFrame:
    """n_sim, rate: how often independent walks reject rank 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [rank_of(trace_test(np.cumsum(np.random.default_rng([seed, int(i)]).normal(0, 0.012, (n_obs, n_series)), axis=0), lags)[0]) > 0 for i in batch.id]
            yield pd.DataFrame({"hit": np.array(hits, float)})

    return spark.range(n_sim).mapInPandas(run, "hit double").agg(F.count("*").alias("n_sim"), F.avg("hit").alias("rate"))
