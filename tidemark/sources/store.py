"""Parquet store of snapshots, attributes and registry buckets, partitioned by collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import registry, snapshots
from tidemark.sources import tables


class Store:
    """Tables under one path on any Hadoop file system. A write replaces only the partitions of the collections it has rows
    for; it is staged first, as a partition can't be read while it is replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The table; empty where nothing has been written."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _replace(self, name: str, rows: DataFrame, schema: T.StructType) -> None:
        cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        stage = f"{self.path}/_stage/{name}"
        cast.write.mode("overwrite").parquet(stage)
        staged = self.spark.read.schema(schema).parquet(stage)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_key").parquet(f"{self.path}/{name}")

    def _with_old(self, name: str, new: DataFrame, schema: T.StructType) -> DataFrame:
        """Stored rows of the collections that ``new`` has."""
        return self.read(name, schema).join(new.select("collection_key").distinct(), "collection_key", "left_semi")

    def append_snapshots(self, new: DataFrame) -> None:
        """Fold new samples onto what is stored, by collection, model and backdrop."""
        old = self._with_old("snapshots", new, tables.SNAPSHOTS)
        both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)), allowMissingColumns=True)
        rest = [f.name for f in tables.SNAPSHOTS.fields if f.name not in ("collection_key", "model_key", "backdrop_key", "sampled_at", "floor_native")]
        packed = both.select("collection_key", "model_key", "backdrop_key", "sampled_at", F.col("floor_native").cast("double").alias("floor"), F.struct("__o", *rest).alias("event_id"))
        kept = snapshots.fold(packed, ["collection_key", "model_key", "backdrop_key"])
        self._replace("snapshots", kept.select("collection_key", "model_key", "backdrop_key", "sampled_at", F.col("floor").alias("floor_native"), *[F.col(f"event_id.{c}").alias(c) for c in rest]), tables.SNAPSHOTS)

    def upsert_attributes(self, new: DataFrame) -> None:
        old = self._with_old("attributes", new, tables.ATTRIBUTES)
        self._replace("attributes", registry.upsert(old, new, ["collection_key", "trait_type", "value_key"], "updated_at"), tables.ATTRIBUTES)

    def prune(self, as_of: Column, days: int = snapshots.RETENTION_DAYS) -> None:
        """Drop old snapshots; a collection that loses all keeps an empty partition only until it is next written."""
        kept = snapshots.retain(self.read("snapshots", tables.SNAPSHOTS), as_of, days)
        self._replace("snapshots", kept, tables.SNAPSHOTS)

    def ingest_buckets(self, floors: DataFrame, snapshot_at: Column, buckets: int = 32) -> None:
        """Replace the buckets of the scanned collections, and append changed or due entries to the history."""
        new = registry.with_bucket(floors, buckets)
        flat = new.select("collection_key", "bucket", "combo", "model", "backdrop", "floor", "listed", F.col("floor_market").alias("marketplace"), F.col("floor_listing").alias("listing_id"), snapshot_at.alias("snapshot_at"))
        schema = T.StructType().add("collection_key", "string").add("bucket", "integer").add("combo", "string").add("model", "string").add("backdrop", "string").add("floor", "double").add("listed", "long").add("marketplace", "string").add("listing_id", "string").add("snapshot_at", "timestamp")
        as_entries = lambda d: d.select(F.col("collection_key").alias("collection"), "combo", "floor", "listed")
        past = T.StructType().add("collection_key", "string").add("combo", "string").add("floor", "double").add("listed", "long").add("sampled_at", "timestamp")
        last = self.read("history", past).groupBy(F.col("collection_key").alias("collection"), "combo").agg(F.max("sampled_at").alias("sampled_at"))
        changed = registry.diff(as_entries(self._with_old("registry", flat, schema)), as_entries(flat), last, snapshot_at)
        changed.select(F.col("collection").alias("collection_key"), "combo", F.col("floor").cast("double").alias("floor"), F.col("listed").cast("long").alias("listed"), snapshot_at.alias("sampled_at")).write.mode("append").partitionBy("collection_key").parquet(f"{self.path}/history")
        self._replace("registry", flat, schema)

    def lookup(self, requests: DataFrame, buckets: int = 32) -> DataFrame:
        """Registry rows of requested (collection, model, backdrop): by collection and bucket, so partitions are pruned."""
        asked = registry.with_bucket(requests, buckets).select("collection_key", "bucket", "combo").distinct()
        schema = T.StructType().add("collection_key", "string").add("bucket", "integer").add("combo", "string").add("floor", "double").add("listed", "long").add("snapshot_at", "timestamp")
        return asked.join(self.read("registry", schema), ["collection_key", "bucket", "combo"])
