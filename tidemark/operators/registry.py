"""Listing scans reduced to floors per attribute combination; buckets, lookups, differences and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers, text

COMBO = ["collection", "model", "backdrop"]


def combo_floor(listings: DataFrame, by: list[str] = COMBO) -> DataFrame:
    """Lowest price, its listing and market, and the number of distinct listings of each combination.

    Rows without a positive price or with a blank trait are skipped; a listing id counts once, at its lowest price. Ties go
    to the smaller id. Both steps aggregate before their shuffle, so a hot combination is no hot task.
    """
    valid = F.col("price") > 0
    for c in by:
        valid = valid & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    once = listings.where(valid).groupBy(*by, "listing_id").agg(F.min(F.struct("price", "market")).alias("x"))
    low = F.struct("x.price", "listing_id")
    return once.groupBy(*by).agg(F.min("x.price").alias("floor"), F.min_by("listing_id", low).alias("floor_listing"), F.min_by("x.market", low).alias("floor_market"), F.count("*").alias("listed"))


def with_bucket(floors: DataFrame, buckets: int = 32) -> DataFrame:
    """Adds collection_key, combo (model:backdrop key) and the hash bucket of the combo."""
    combo = text.combo_key(F.col("model"), F.col("backdrop"))
    return floors.withColumns({"collection_key": text.key(F.col("collection")), "combo": combo, "bucket": numbers.bucket(combo, buckets)})


def bucket_maps(floors: DataFrame, buckets: int = 32) -> DataFrame:
    """One row per collection and bucket with its entries as a map; bounded by the combinations of one collection."""
    entry = F.struct("combo", F.struct("model", "backdrop", "floor", "listed", "floor_market", "floor_listing"))
    return with_bucket(floors, buckets).groupBy("collection_key", "bucket").agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))


def thin(floor: Column, listed: Column) -> Column:
    """A positive floor of at most one listing isn't trusted."""
    return (floor > 0) & (listed <= 1)


def lookup_by_alias(requests: DataFrame, registry: DataFrame, request_id: str, keys: Column, registry_key: str) -> DataFrame:
    """Each request with the registry row of its first key that is there; requests without one keep nulls."""
    tried = requests.select(request_id, F.posexplode(keys).alias("__pos", "__key"))
    hits = tried.join(registry, tried["__key"] == registry[registry_key])
    names = [c for c in registry.columns]
    best = hits.groupBy(request_id).agg(F.min_by(F.struct("__pos", *names), "__pos").alias("__hit"))
    return requests.join(best, request_id, "left").select(*[requests[c] for c in requests.columns], F.col("__hit.__pos").alias("key_rank"), *[F.col(f"__hit.{n}").alias(n) for n in names])


def stats(floors: DataFrame) -> DataFrame:
    return floors.agg(F.countDistinct("collection").alias("collections"), F.count("*").alias("combinations"), F.coalesce(F.sum("listed"), F.lit(0)).alias("listings"), F.max("floor").alias("highest_floor"))


def by_collection(floors: DataFrame) -> DataFrame:
    return floors.groupBy("collection").agg(F.count("*").alias("combinations"), F.sum("listed").alias("listings"), F.min("floor").alias("floor"))


def diff(old: DataFrame, new: DataFrame, last_sample: DataFrame, as_of: Column, resample_hours: int = 24, keep_removed: bool = False) -> DataFrame:
    """Entries to write to history: changed or new ones, and those last sampled ``resample_hours`` ago or never.

    ``old`` and ``new`` have collection, combo, floor, listed; ``last_sample`` has collection, combo, sampled_at. Removed
    entries leave no trace unless ``keep_removed``.
    """
    keys = ["collection", "combo"]
    o = old.select(*keys, F.struct("floor", "listed").alias("was"))
    n = new.select(*keys, F.struct("floor", "listed").alias("now"))
    both = o.join(n, keys, "full").join(last_sample.select(*keys, "sampled_at"), keys, "left")
    return changes(both, as_of, resample_hours, keep_removed)


def changes(both: DataFrame, as_of: Column, resample_hours: int = 24, keep_removed: bool = False) -> DataFrame:
    """``diff`` of entries that already lie side by side: collection, combo, structs was and now (floor, listed), sampled_at."""
    changed = ~F.col("was").eqNullSafe(F.col("now"))
    due = F.col("sampled_at").isNull() | (F.unix_micros(as_of) - F.unix_micros("sampled_at") >= resample_hours * 3_600_000_000)
    reason = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "new").when(changed, "changed").otherwise("resample")
    out = both.where(changed | due).withColumn("reason", reason)
    out = out if keep_removed else out.where(F.col("now").isNotNull())
    return out.select("collection", "combo", F.col("now.floor").alias("floor"), F.col("now.listed").alias("listed"), "reason")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key; of several, all columns of the one with the greatest ``order``."""
    names = old.columns
    both = old.unionByName(new.select(*names))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("__r")).select("__r.*")


def missing(requests: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return requests.select(*keys).distinct().join(registry, keys, "left_anti")


def heal_worklist(requests: DataFrame, registry: DataFrame, keys: list[str], as_of: Column, recent: DataFrame | None = None, stale_hours: int = 3, limit: int = 250) -> DataFrame:
    """Missing keys, then stale ones, oldest first, without those tried recently; at most ``limit``."""
    wanted = requests.select(*keys).distinct().join(registry.select(*keys, "snapshot_at"), keys, "left")
    age = F.unix_micros(as_of) - F.unix_micros("snapshot_at")
    work = wanted.where(F.col("snapshot_at").isNull() | (age > stale_hours * 3_600_000_000)).withColumn("reason", F.when(F.col("snapshot_at").isNull(), "missing").otherwise("stale"))
    if recent is not None:
        work = work.join(recent.select(*keys), keys, "left_anti")
    return work.orderBy(F.col("snapshot_at").asc_nulls_first(), *keys).limit(limit)


def fuzzy_resolve(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested names to the one stored name that shares a signature; none where several do."""
    left = requests.select("name", F.explode(text.signature_keys(F.col("name"))).alias("s")).distinct()
    right = stored.select(F.col("name").alias("stored"), F.explode(text.signature_keys(F.col("name"))).alias("s")).distinct()
    return left.join(right, "s").groupBy("name").agg(F.countDistinct("stored").alias("n"), F.min("stored").alias("stored")).where("n = 1").select("name", "stored")
