"""Record normalisers on payloads that are null, of other shapes, or half filled."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import records as C


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("payload", F.try_parse_json("payload"))


ODD = [None, "{}", "[]", "1", '"text"', '{"models": 5, "balances": {}, "price": "x"}', "not json"]


@pytest.mark.parametrize("name", ["floor_records", "model_records", "attribute_records", "holding_pairs", "token_balances", "indexed_balances", "worker_sales", "chart_points", "wallet_points"])
def test_odd_payloads_give_no_records(spark, name):
    key = {"holding_pairs": "asset_id", "token_balances": "wallet", "indexed_balances": "wallet", "chart_points": "token", "wallet_points": "wallet"}.get(name, "name")
    df = frame(spark, [("k", p) for p in ODD], f"{key} string, payload string")
    assert getattr(C, name)(df).count() == 0
    assert getattr(C, name)(df.limit(0)).count() == 0


def test_first_candidate_that_counts(spark):
    df = frame(spark, [('{"a": 0, "b": "2.5", "c": 3, "s": "", "t": "x"}',)], "payload string")
    r = df.select(C.number(F.col("payload"), "a", "b", "c").alias("n"), C.present(F.col("payload"), "a", "b").alias("p"), C.string(F.col("payload"), "s", "t").alias("s"), C.string(F.col("payload"), "zz", default="none").alias("z")).first()
    assert tuple(r) == (2.5, 0.0, "x", "none")


def test_points_without_a_time_count_back(spark):
    df = frame(spark, [("a", '{"floor": {"tonUsdRate": 2}, "floorHistory": [{"ton": 1}, {"ton": 2, "date": "2024-01-01"}, {"usd": 9}]}', 0.0, 0.0)], "asset_id string, payload string, floor_native double, floor_usd double")
    got = C.floor_points(df, F.lit("2024-02-03").cast("timestamp")).orderBy("price_usd").collect()
    assert [(str(r.at), r.price_usd) for r in got] == [("2024-02-01 00:00:00", 2.0), ("2024-01-01 00:00:00", 4.0), ("2024-02-03 00:00:00", 9.0)]


def test_tokens_without_a_price(spark):
    df = frame(spark, [("w", '{"summary": {"tonBalance": 2}, "assets": {"jettons": [{"balance": 4, "valueUsd": 8}, {"symbol": "S"}]}}')], "wallet string, payload string")
    got = {r.symbol: (r.balance, r.price_usd, r.value_usd) for r in C.imported_tokens(df, 3.0).collect()}
    assert got == {"TON": (2.0, 3.0, 6.0), "JET1": (4.0, 2.0, 8.0), "S": (0.0, 0.0, 0.0)}


def test_accounts_and_items_of_null_payloads(spark):
    df = frame(spark, [("a", None)], "address string, payload string")
    assert tuple(C.accounts(df).first())[2:] == (0.0, "unknown", False)
    r = C.market_items(df, 3.0).first()
    assert (r.name, r.floor_native, r.listed) == ("Collectible", 0.0, False)
