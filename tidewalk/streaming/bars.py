"""The same bars and position rule over streams: late events wait for a watermark, positions are kept per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DAILY, Params


def bars(events: DataFrame, length: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """symbol, ts, close, high, low, volume of event types; a bar comes out once the watermark has passed it."""
    known = events.where("value IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp"))
    grouped = known.withWatermark("at", lateness).groupBy(F.col("event_type").alias("symbol"), F.window("at", length))
    last = F.max_by("value", F.struct("at", "event_id"))
    out = grouped.agg(last.alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.round(F.sum("value"), 2).alias("volume"))
    return out.select("symbol", F.col("window.start").alias("ts"), "close", "high", "low", "volume")


def positions(scores: DataFrame, p: Params = DAILY) -> DataFrame:
    """symbol, t, z, pos of a stream (symbol, t, z, broken): the state of a series is its position and its bar on re-entry.

    Rows of a series must arrive in the order of t over micro-batches; inside one they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t", ignore_index=True)
        held, barred = state.get if state.exists else (0.0, False)
        out = []
        for z, broken in zip(rows.z.astype(float), rows.broken.astype(bool), strict=True):
            held, barred = next_state(held, barred, z, broken, p)
            out.append(held)
        state.update((held, barred))
        yield pd.DataFrame({"symbol": key[0], "t": rows.t, "z": rows.z, "pos": out})

    return scores.groupBy("symbol").applyInPandasWithState(step, "symbol string, t long, z double, pos double", "held double, barred boolean", "append", GroupStateTimeout.NoTimeout)


def next_state(held: float, barred: bool, z: float, broken: bool, p: Params) -> tuple[float, bool]:
    """One step of the batch rule from a given state."""
    size = abs(z)
    if size != size:
        return 0.0, barred
    if broken or (held and size >= p.stop):
        return 0.0, True
    if held:
        return (0.0 if size <= p.exit_ else held), barred
    if barred:
        return 0.0, size > p.exit_
    return (-1.0 if z > 0 else 1.0) if size >= p.entry else 0.0, False


__all__ = ["bars", "next_state", "positions"]
