"""Batch jobs over the store, and names matched at awkward lengths."""

from pyspark.sql import functions as F

from tidemark.operators import matching as M
from tidemark.plans import jobs
from tidemark.sources import tables
from tidemark.sources.store import Store


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, payload string").withColumn("payload", F.parse_json("payload"))


def test_collect_again_changes_nothing(spark, tmp_path):
    store, at = Store(spark, str(tmp_path)), F.lit("2024-01-05").cast("timestamp")
    floors = frame(spark, [("Red Cat", '{"floorTon": 2, "floorUsd": 6, "listedCount": 3}'), ("None", "{}")])
    attributes = frame(spark, [("Red Cat", '{"models": [{"name": "A", "stats": {"floor": 2000000000, "count": 4}}, {"name": "B"}], "patterns": [{"value": "P", "rarity_per_mille": 15}]}')])
    seen = []
    for _ in range(2):
        jobs.collect(store, floors, attributes, at)
        s = store.read("snapshots", tables.SNAPSHOTS).collect()
        a = store.read("attributes", tables.ATTRIBUTES).collect()
        seen.append((sorted((r.collection_key, float(r.floor_native), float(r.usd_rate), r.listed_count) for r in s), sorted((r.trait_type, r.value_key, r.rarity, r.item_count, float(r.floor_native)) for r in a)))
    assert seen[0] == seen[1] == ([("redcat", 2.0, 3.0, 3)], [("Model", "a", 0.0, 4, 2.0), ("Model", "b", 0.0, 0, 0.0), ("Symbol", "p", 1.5, 0, 0.0)])


def test_model_floors_prefer_the_first_provider(spark, tmp_path):
    store, at = Store(spark, str(tmp_path)), F.lit("2024-01-05").cast("timestamp")
    names, listed = spark.createDataFrame([("red cats",)], "name string"), spark.createDataFrame([(1, "Red Cat"), (2, "Dog")], "ord long, title string")
    first = frame(spark, [("Red Cat", '{"models": [{"name": "A", "stats": {"floor": 2e9}}]}'), ("Dog", '{"models": [{"name": "Z", "stats": {"floor": 5e9}}]}')])
    second = frame(spark, [("Red Cat", '{"models": [{"name": "a", "floor": 9e9}, {"name": "C", "floor": 3e9}]}')])
    got = {r.value_key: (r.floor_native, r.floor_usd) for r in jobs.model_floors(store, names, listed, first, second, 3.0, at).collect()}
    assert got == {"a": (2.0, 6.0), "c": (3.0, 9.0)}


def test_contained_at_all_lengths(spark):
    words = ["a", "ab", "abc", "abcd", "bcd", "xabcx", "zz", "z", "éa", "aaaa", "aaa"]
    df = lambda c: spark.createDataFrame([(w,) for w in words], f"{c} string")
    got = {tuple(r) for r in M.contained(df("x"), df("y")).collect()}
    assert got == {(x, y) for x in words for y in words if x in y}


def test_short_names_do_not_match_within_others(spark):
    catalog = spark.createDataFrame([(1, "Lost Dogs Club", "Dog", "addr1", 5.0, 0.0), (2, "Lost Dogs Club", "Dog Original", "addr2", 3.0, 0.0), (3, "Cats", "Golden Apple Pie", None, 20000.0, 0.0)], "ord long, collection string, item string, address string, usd double, native double")
    none = []
    asked = [("fuzzy", ["Dog Original Edition #5"], none, ["x"]), ("short", ["Dogs"], none, ["Dogs"]), ("named", ["Lost Dogs Club"], ["dog"], ["Lost Dogs Club"]), ("gone", ["Lost Dogs Club"], ["cow"], ["Lost Dogs Club"]), ("wide", ["zzz"], none, ["The Lost Dogs Club #2"]), ("dear", ["Golden Apple Pie"], none, none), ("addr", ["ADDR1"], none, none), ("null", [None], [None], [None])]
    requests = spark.createDataFrame(asked, "request string, aliases array<string>, items array<string>, collections array<string>")
    assert {(r.request, r.ord, r.source) for r in M.snapshot_match(requests, catalog, 2.0).collect()} == {("fuzzy", 2, "exact"), ("named", 1, "exact"), ("wide", 2, "collection"), ("addr", 1, "exact")}
    assert {(r.request, r.collection, r["item"]) for r in M.live_match(requests, catalog).collect()} == {("fuzzy", "Lost Dogs Club", "Dog Original"), ("named", "Lost Dogs Club", None), ("gone", "Lost Dogs Club", None), ("dear", "Cats", "Golden Apple Pie")}
    assert M.snapshot_match(requests.limit(0), catalog, 2.0).count() == 0 == M.live_match(requests, catalog.limit(0)).count()
