"""Normal distribution and unit-root p-values as column expressions (Spark has no error function)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 26.2.17, error below 7.5e-8.
P0 = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: MacKinnon (1994) response surface, two series, constant.
TAU_MAX, TAU_MIN, TAU_STAR = 0.92, -18.86, -2.62
SMALL_P, LARGE_P = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)


def _poly(x: Column, c: tuple) -> Column:
    out = F.lit(c[-1])
    for k in c[-2::-1]:
        out = out * x + F.lit(k)
    return out


def normal_cdf(z: Column) -> Column:
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(P0) * F.abs(z))
    tail = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi)) * (_poly(k, B) * k)
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def mackinnon_p(t: Column) -> Column:
    """p-value of an Engle-Granger t statistic."""
    z = F.when(t <= TAU_STAR, _poly(t, SMALL_P)).otherwise(_poly(t, LARGE_P))
    return F.when(t > TAU_MAX, 1.0).when(t < TAU_MIN, 0.0).otherwise(normal_cdf(z))


def _poly_sql(x: str, c: tuple) -> str:
    out = repr(c[-1])
    for k in c[-2::-1]:
        out = f"({out} * {x} + {k!r})"
    return out


def normal_cdf_sql(z: str) -> str:
    k = f"(1.0 / (1.0 + CAST({P0} AS DOUBLE) * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * ({_poly_sql(k, B)} * {k}))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def mackinnon_p_sql(t: str) -> str:
    z = f"(CASE WHEN {t} <= {TAU_STAR} THEN {_poly_sql(t, SMALL_P)} ELSE {_poly_sql(t, LARGE_P)} END)"
    return f"(CASE WHEN {t} > {TAU_MAX} THEN 1.0 WHEN {t} < {TAU_MIN} THEN 0.0 ELSE {normal_cdf_sql(z)} END)"
