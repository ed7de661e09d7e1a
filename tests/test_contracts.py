import datetime as dt
import json

import duckdb

from tidewalk import registry
from tidewalk.sources.files import contracts


def test_dates_of_large_keys_equal_sql(spark, tmp_path):
    """Delivery dates pass the open-ended mark from key 25,571 on."""
    path = f"{tmp_path}/customer.parquet"
    spark.range(1, 60_000, 7).selectExpr("id AS c_custkey").write.parquet(path)
    want = duckdb.sql(f"WITH customer AS (SELECT * FROM '{path}/*.parquet') " + registry.ORACLES["s10_contracts"]).fetchall()
    got = registry.QUERIES["s10_contracts"](spark, str(tmp_path)).select("symbol", "status", "onboard", "delivery").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert max(r.delivery for r in got if r.delivery) > dt.datetime(2150, 1, 1)


def test_open_ended(spark):
    one = {"contractType": "PERPETUAL", "quoteAsset": "USDT", "status": "TRADING", "onboardDate": 0}
    dates = {"exchange": 4_133_404_800_000, "last": 4_102_444_800_000, "later": 4_200_000_000_000, "none": None}
    raw = spark.createDataFrame([(json.dumps([one | {"symbol": k, "deliveryDate": v} for k, v in dates.items()]),)], "json string")
    assert {r.symbol for r in contracts(raw).collect() if r.delivery} == {"last"}
    assert {r.symbol for r in contracts(raw, open_ended=4_133_404_800_000).collect() if r.delivery} == {"last", "later"}
