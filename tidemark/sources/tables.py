"""Domain relations from the star-schema tables, and the schemas of the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decimal(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


#: Stores at rest. Prices are decimals here only; operators compute in doubles.
COLLECTIONS = T.StructType().add("collection_key", "string", False).add("name", "string").add("external_id", "string").add("recent_sales", "string").add("updated_at", "timestamp")
SNAPSHOTS = (
    T.StructType().add("collection_key", "string", False).add("model_key", "string").add("backdrop_key", "string").add("sampled_at", "timestamp", False)
    .add("floor_native", _decimal(24, 9)).add("floor_usd", _decimal(24, 6)).add("usd_rate", _decimal(18, 8)).add("listed_count", "integer").add("source", "string")
)
ATTRIBUTES = T.StructType().add("collection_key", "string", False).add("trait_type", "string", False).add("value_key", "string", False).add("rarity", "double").add("item_count", "integer").add("floor_native", _decimal(24, 9)).add("updated_at", "timestamp")
ENTRY = T.StructType().add("model", "string").add("backdrop", "string").add("floor", "double").add("listed", "integer").add("marketplace", "string").add("url", "string").add("listing_id", "string")
REGISTRY = T.StructType().add("collection_key", "string", False).add("bucket", "integer", False).add("snapshot_at", "timestamp").add("entries", T.MapType(T.StringType(), ENTRY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("collection"), F.col("p_type").alias("model"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("backdrop"), F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("market"), F.col("l_extendedprice").alias("price"), ident.alias("listing_id"), F.col("l_shipdate").cast("timestamp").alias("sold_at"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("collection"), F.col("p_type").alias("model"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("backdrop"), F.col("l_linestatus").alias("market"), price.alias("price"), F.col("l_shipdate").cast("timestamp").alias("sold_at"), ident.alias("sale_id"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, orders = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("wallet"), F.col("p_brand").alias("collection"), F.col("p_type").alias("model"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("backdrop"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("cost"), F.col("p_retailprice").alias("floor"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("asset_id"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("user_id").alias("model"), F.col("ts").cast("timestamp").alias("sampled_at"), F.round(F.col("value") / 100).alias("floor"), "event_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed movements: purchases and sign-ups come in, clicks go out."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "click"))
    sign = F.when(F.col("event_type") == "click", -1.0).otherwise(1.0)
    return events.select(F.col("user_id").alias("wallet"), F.col("ts").cast("timestamp").alias("at"), (sign * F.col("value")).alias("amount"), "event_id")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("wallet"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"), "event_id")
