"""Learned signal: features and targets with keys, walk-forward splits, learners, and smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 2, 3, 5, 10)
LAGS = (1, 2, 5, 10, 20)
FEATURES = ["r1", "r2", "r5", "r10", "r20", "s_score", "b", "hl", "disp", "vol_ratio", "adv_rank", "drawdown"]


def features(scores: DataFrame, residuals: DataFrame, rets: DataFrame, factor: DataFrame, window: int, per_year: int = 252, max_half_life: float = 30.0, least: int = 20) -> DataFrame:
    """date, symbol, t, FEATURES, y1..y10, sigma_step of the rows that have them all.

    scores: one factor's OU scores (symbol, t); residuals: each window's residuals with its beta. Targets are sums of
    later returns less beta times the factor, over sigma_step times the root of the horizon; the intercept stays in.
    """
    back = F.col("t") - F.col("didx")
    sums = [F.sum(F.when(back < k, F.col("resid"))).alias(f"r{k}") for k in LAGS]
    recent = F.stddev_samp(F.when(back < 20, F.col("resid"))) / F.stddev_samp("resid")
    moves = residuals.groupBy("symbol", "t").agg(*sums, recent.alias("vol_ratio"), F.first("beta").alias("beta"))
    name = Window.partitionBy("symbol").orderBy("didx")
    ahead = rets.join(F.broadcast(factor.select("didx", "f")), "didx")  # a row a session
    both = lambda c, k: F.sum(c).over(name.rangeBetween(1, k))
    counted = lambda k: F.count("ret").over(name.rangeBetween(1, k))
    ahead = ahead.select(
        "symbol", "date", F.col("didx").alias("t"), *(F.when(counted(k) == k, both("ret", k)).alias(f"a{k}") for k in HORIZONS), *(both("f", k).alias(f"f{k}") for k in HORIZONS),
        (F.col("close") / F.max("close").over(name.rangeBetween(-(window - 1), 0)) - 1).alias("drawdown"), "dollar_volume",
    )
    rows = scores.join(moves, ["symbol", "t"]).join(ahead, ["symbol", "t"])
    day = Window.partitionBy("t")
    rows = rows.withColumn("hl", F.ln(F.lit(2.0)) / F.col("kappa") * per_year).withColumn("disp", F.stddev_pop("s_score").over(day)).withColumn("adv_rank", F.percent_rank().over(day.orderBy("dollar_volume", "symbol")))
    for k in HORIZONS:
        rows = rows.withColumn(f"y{k}", (F.col(f"a{k}") - F.col("beta") * F.col(f"f{k}")) / F.when(F.col("sigma_step") > 0, F.col("sigma_step") * F.sqrt(F.lit(float(k)))))
    targets = [f"y{k}" for k in HORIZONS]
    known = rows.where((F.col("hl") > 0) & (F.col("hl") <= max_half_life)).dropna(subset=[*FEATURES, *targets, "sigma_step"])
    return known.withColumn("_n", F.count("*").over(day)).where(F.col("_n") >= least).select("date", "symbol", "t", *FEATURES, *targets, "sigma_step")


def permuted(rows: DataFrame, target: str, seed: int) -> DataFrame:
    """Rows with the target dealt anew within each date: a null that keeps every date's distribution."""
    day = Window.partitionBy("date")
    mixed = F.md5(F.concat("symbol", F.date_format("date", "yyyyMMdd"), F.lit(f"/{seed}")))
    dealt = rows.select("date", F.col(target).alias("_y"), F.row_number().over(day.orderBy(mixed, "symbol")).alias("_k"))
    return rows.withColumn("_k", F.row_number().over(day.orderBy("symbol"))).join(dealt, ["date", "_k"]).withColumn(target, F.col("_y")).drop("_y", "_k")


def splits(rows: DataFrame, first_year: int, last_year: int, val_frac: float = 0.2, least: int = 50_000) -> DataFrame:
    """Rows once for each test year they serve: test_year and part ('train', 'val', 'test').

    Training rows are of earlier years; the last val_frac of them, by date and weighted by rows, validate.
    """
    years = rows.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("test_year"))
    day = F.unix_timestamp(F.col("date").cast("timestamp")).cast("double")
    joined = rows.join(F.broadcast(years), F.year("date") <= F.col("test_year"))  # a row a year
    past = joined.where(F.year("date") < F.col("test_year")).groupBy("test_year").agg(F.percentile(day, F.lit(1 - val_frac)).alias("_cut"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    part = F.when(F.year("date") == F.col("test_year"), "test").when(day <= F.col("_cut"), "train").otherwise("val")
    return joined.join(F.broadcast(past.drop("_n")), "test_year").withColumn("part", part).drop("_cut")


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by the mean and deviation of the training rows of their test year; a deviation of 0 counts as 1."""
    train = F.col("part") == "train"
    stats = [f(F.when(train, F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    scaled = rows.join(F.broadcast(rows.groupBy("test_year").agg(*stats)), "test_year")  # a row a year
    for c in columns:
        sd = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        scaled = scaled.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / sd)
    return scaled.drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def ridge(rows: DataFrame, columns: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """date, symbol, test_year, pred by linear regression: sums in the engine, a small solve per year."""
    terms = [F.lit(1.0), *map(F.col, columns)]
    train = rows.where("part = 'train'")
    grams = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    moments = [F.sum(a * F.col(target)).alias(f"m{i}") for i, a in enumerate(terms)]
    k = len(terms)

    def solve(sums: pd.DataFrame) -> pd.DataFrame:
        r = sums.iloc[0]
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty * np.diag([0.0] + [1.0] * (k - 1))
        return pd.DataFrame({"test_year": [r.test_year], "w": [np.linalg.solve(g, np.array([r[f"m{i}"] for i in range(k)])).tolist()]})

    weights = train.groupBy("test_year").agg(*grams, *moments).groupBy("test_year").applyInPandas(solve, "test_year int, w array<double>")
    pred = sum((F.col("w")[i] * t for i, t in enumerate(terms[1:], 1)), F.col("w")[0])
    return rows.where("part = 'test'").join(F.broadcast(weights), "test_year").select("date", "symbol", "test_year", pred.alias("pred"))


class Network:
    """A 64-32 ReLU network with dropout, trained by AdamW on squared error with early stopping."""

    def __init__(self, n_in: int, seed: int, widths: tuple[int, ...] = (64, 32), dropout: float = 0.2) -> None:
        self.rng, self.dropout = np.random.default_rng(seed), dropout
        sizes = [n_in, *widths, 1]
        self.params = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (self.rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        kept = []
        for i in range(0, len(self.params), 2):
            kept.append(x)
            x = x @ self.params[i] + self.params[i + 1]
            if i + 2 < len(self.params):
                mask = x > 0
                if train:
                    mask = mask * (self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
                kept.append(mask)
                x = x * mask
        return x[:, 0], kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        out, kept = self.forward(x, True)
        g, grads = (2 * (out - y) / len(y))[:, None], []
        for i in range(len(self.params) - 2, -1, -2):
            grads[:0] = [kept[i].T @ g, g.sum(0)]
            if i:
                g = (g @ self.params[i].T) * kept[i - 1]
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 40, batch: int = 4096, patience: int = 5, rate: float = 1e-3, decay: float = 1e-4) -> None:
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        best, kept, waited, step = np.inf, [p.copy() for p in self.params], 0, 0
        for _ in range(epochs):
            order = self.rng.permutation(len(y))
            for i in range(0, len(y), batch):
                step += 1
                for j, g in enumerate(self.gradients(x[order[i : i + batch]], y[order[i : i + batch]])):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    move = first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
                    self.params[j] = self.params[j] * (1 - rate * decay) - rate * move
            loss = float(((self.forward(xv)[0] - yv) ** 2).mean()) if len(yv) else 0.0
            waited = 0 if loss < best - 1e-9 else waited + 1
            if not waited:
                best, kept = loss, [p.copy() for p in self.params]
            if waited >= patience:
                break
        self.params = kept


def network(rows: DataFrame, columns: list[str], target: str, seeds: int = 3, epochs: int = 40) -> DataFrame:
    """date, symbol, test_year, seed, pred: one network for each test year and seed, trained where its rows meet."""
    dealt = rows.select("date", "symbol", "test_year", "part", target, *columns).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["date", "symbol"], ignore_index=True)
        x, y = group[columns].to_numpy(np.float32).astype(float), group[target].to_numpy()
        part = group["part"].to_numpy()
        net = Network(len(columns), int(group["seed"].iloc[0]) + 1)
        net.fit(x[part == "train"], y[part == "train"], x[part == "val"], y[part == "val"], epochs)
        out = group.loc[part == "test", ["date", "symbol", "test_year", "seed"]].copy()
        out["pred"] = net.forward(x[part == "test"])[0]
        return out

    return dealt.groupBy("test_year", "seed").applyInPandas(run, "date date, symbol string, test_year int, seed int, pred double")


def seed_average(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("date", "symbol").agg(F.avg("pred").alias("pred"))


def information_coefficient(rows: DataFrame, prediction: str, target: str, least: int = 5) -> DataFrame:
    """days, mean, sd, t_stat of the daily cross-sectional correlation, on days with more than `least` names."""
    daily = rows.groupBy("date").agg(F.count("*").alias("n"), F.corr(prediction, target).alias("ic")).where((F.col("n") > least) & F.col("ic").isNotNull() & ~F.isnan("ic"))
    out = daily.agg(F.count("*").alias("days"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"))
    return out.withColumn("t_stat", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("days")))


def smoothed(column: str, span: int, key: str = "symbol", order: str = "didx", reach: int = 64) -> Column:
    """Exponentially weighted mean of the last `reach` sessions with adjusted weights; gaps age the weights too."""
    keep = 1 - 2 / (span + 1)
    over = Window.partitionBy(key).orderBy(order).rangeBetween(-(reach - 1), 0)
    seen = F.filter(F.collect_list(F.struct(F.col(order).alias("i"), F.col(column).alias("v"))).over(over), lambda x: x["v"].isNotNull())
    weight = lambda x: F.pow(F.lit(keep), F.col(order) - x["i"])
    total = F.aggregate(seen, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("w")), lambda s, x: F.struct((s["a"] + weight(x) * x["v"]).alias("a"), (s["w"] + weight(x)).alias("w")))
    return F.try_divide(total["a"], total["w"])
