"""Two-pass external shuffle into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, numbered, shared_path


def rendezvous(key: Column, shards: int) -> Column:
    """Shard with the greatest hash of key and shard: one more shard takes rows only into itself."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(7919)).alias("h"), s.alias("s")))
    return F.array_max(scores)["s"]


def shard_records(docs: DataFrame, shards: int = 40, bucket_bytes: int = 32 << 20, seed: int = 23, id_col: str = "doc_id") -> DataFrame:
    """Rows with shard, grown_shard (of one more shard) and slot (gapless from 0 in each shard, in random order).

    Pass 1 scatters each shard's rows into buckets of about ``bucket_bytes`` by a hash of the seed and the whole row, one
    bucket per task; pass 2 puts a bucket's rows in the order of their hashes, applies a Fisher-Yates shuffle seeded by
    ``seed`` and the bucket's number, and numbers the rows after the buckets before it. So slots follow from the seed and
    the rows, whatever partitions they came in. The shard follows the id and the number of shards alone (a null id is one
    more key); rows of one id or of one text, and rows equal in all columns, scatter within their shard as any others.
    Repeated rows keep their number, as do null and empty texts. Columns of the names added are replaced; no rows give none.
    """
    base = docs.drop("shard", "grown_shard", "slot")
    names, key = [f"`{c}`" for c in base.columns], F.col(f"`{id_col}`")
    size = sum((F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in names), F.lit(16)).cast("long")
    placed = numbered(base).select("*", rendezvous(key, shards).alias("shard"), rendezvous(key, shards + 1).alias("grown_shard"), size.alias("__size"))
    # At most a row per shard comes to the driver.
    held = {r.shard: r.b for r in placed.groupBy("shard").agg(F.sum("__size").alias("b")).collect()}
    plan, total = [], 0
    for shard, b in sorted(held.items()):
        plan.append((shard, -(-b // bucket_bytes), total))
        total += plan[-1][1]
    table = F.broadcast(docs.sparkSession.createDataFrame(plan, "shard int, __buckets long, __first long"))
    bucket = (F.col("__first") + F.pmod(F.xxhash64(F.lit(seed), "__row", "__occ"), F.col("__buckets"))).cast("int")
    dealt = placed.join(table, "shard").withColumn("__bucket", bucket)
    counts = dealt.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    # One shard's buckets, not its rows, come together here: 24 bytes for each of ``bucket_bytes`` of rows.
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("__start")))
    whole = dealt.select(F.struct(*names).alias("r"), "shard", "grown_shard", "__row", "__occ", "__bucket").repartitionById(max(1, total), "__bucket").sortWithinPartitions("__bucket", "__row", "__occ")
    lists = whole.groupBy("__bucket").agg(F.collect_list(F.struct("r", "shard", "grown_shard")).alias("rs"))
    mixed = lists.select("__bucket", F.shuffle("rs", F.lit(seed)).alias("rs")).join(F.broadcast(starts), "__bucket")
    each = mixed.select("__start", F.posexplode("rs").alias("pos", "x"))
    return each.select("x.r.*", "x.shard", "x.grown_shard", (F.col("__start") + F.col("pos")).alias("slot"))


def write_shards(records: DataFrame, path: str | None = None) -> DataFrame:
    """Write the shards as Parquet, a folder each, and return the written table."""
    spark = records.sparkSession
    path = path or shared_path(spark, "shards")
    records.withColumn("shard_folder", F.col("shard")).write.partitionBy("shard_folder").parquet(path)
    return spark.read.parquet(path).drop("shard_folder")
