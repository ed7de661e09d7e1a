import os
import shutil

import numpy as np
from pyspark.sql import functions as F

from tidewalk.operators.positions import hysteresis
from tidewalk.params import DAILY
from tidewalk.sources import panels
from tidewalk.streaming import bars as S

SF = "/root/testdata/sf0.01"


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_bars_equal_batch(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    drain(S.bars(spark.readStream.schema(schema).parquet(str(tmp_path))), "bars", "complete")
    cols = ["symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "high", "low", "volume"]
    got = spark.table("bars").select(*cols)
    want = panels.event_bars(spark, SF)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 100


def test_positions_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 2, 200)
    broken = rng.random(200) < 0.05
    schema = "symbol string, t long, z double, broken boolean"
    for i in range(4):
        rows = [("A", int(t), float(z[t]), bool(broken[t])) for t in range(50 * i, 50 * i + 50)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    for i in range(4):
        shutil.copytree(tmp_path / f"in{i}", tmp_path / "all" / f"b={i}")
        for part in (tmp_path / "all" / f"b={i}").iterdir():
            os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    drain(S.positions(stream.drop("b")), "pos")
    got = {r.t: r.pos for r in spark.table("pos").collect()}
    one = hysteresis(z, broken, DAILY.entry, DAILY.exit_, DAILY.stop)
    assert [got[t] for t in range(200)] == one.tolist()


def test_state_step_equals_scan():
    rng = np.random.default_rng(6)
    z = rng.normal(0, 2.5, 500)
    z[rng.random(500) < 0.05] = np.nan
    broken = rng.random(500) < 0.03
    held, barred, out = 0.0, False, []
    for v, b in zip(z, broken, strict=True):
        held, barred = S.next_state(held, barred, v, b, DAILY)
        out.append(held)
    assert out == hysteresis(z, broken, DAILY.entry, DAILY.exit_, DAILY.stop).tolist()
