"""Batch jobs over the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import catalog, matching, records, snapshots
from tidemark.sources import tables
from tidemark.sources.store import Store


def collect(store: Store, floors: DataFrame, attributes: DataFrame, as_of: Column, days: int = snapshots.RETENTION_DAYS) -> None:
    """One round of the scheduled collector: floor payloads are folded into the snapshots, attribute payloads replace their
    rows, then old snapshots go. Both inputs have name and payload; a round that is run again changes nothing."""
    found = records.floor_records(floors).select("collection_key", F.lit("").alias("model_key"), F.lit("").alias("backdrop_key"), as_of.alias("sampled_at"), "floor_native", "floor_usd", "usd_rate", F.col("listed").cast("int").alias("listed_count"), "source")
    store.append_snapshots(found.dropDuplicates(["collection_key"]))
    rows = records.attribute_records(attributes).select("collection_key", "trait_type", "value_key", "rarity", F.col("item_count").cast("int").alias("item_count"), "floor_native", as_of.alias("updated_at"))
    store.upsert_attributes(rows.where("value_key <> ''").dropDuplicates(["collection_key", "trait_type", "value_key"]))
    store.prune(as_of, days)


def model_floors(store: Store, names: DataFrame, collections: DataFrame, first: DataFrame, second: DataFrame, rate: float, as_of: Column) -> DataFrame:
    """Model floors of requested ``names`` (name): the catalogue's best match of each (``collections`` has ord and title), its
    attributes of both providers (name, payload), the first's before the second's, upserted into the store."""
    wanted = matching.tier_match(names, collections).select(F.col("title").alias("name")).distinct()
    of = lambda d: records.attribute_records(d.join(wanted, "name", "left_semi"))
    keys = ["collection_key", "trait_type", "value_key"]
    mine, theirs = of(first).dropDuplicates(keys), of(second).dropDuplicates(keys)
    merged = mine.unionByName(theirs.join(mine.select(*keys), keys, "left_anti"))
    store.upsert_attributes(merged.where("value_key <> ''").select(*keys, "rarity", F.col("item_count").cast("int").alias("item_count"), "floor_native", as_of.alias("updated_at")))
    models = store.read("attributes", tables.ATTRIBUTES).where("trait_type = 'Model' and floor_native > 0")
    asked = wanted.select(text.key(F.col("name")).alias("collection_key"))
    return models.join(asked, "collection_key", "left_semi").select("collection_key", "value_key", F.col("floor_native").cast("double").alias("floor_native"), (F.col("floor_native").cast("double") * rate).alias("floor_usd"), F.col("item_count").alias("listed"), "rarity")


def resume(targets: DataFrame, done: DataFrame, scanner: str) -> tuple[DataFrame, DataFrame]:
    """What a scan has still to read, and the collections it may publish."""
    return catalog.pages_left(targets, done, scanner), catalog.publishable(targets, done, scanner)
