"""Sales: distinct rows, newest, last exact sale, daily floors, day figures, incremental scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sale_id(given: Column, *parts: str) -> Column:
    """The id, or one made of the parts where it is blank."""
    return F.coalesce(F.when(given != "", given), F.concat_ws("|", *parts))


def unique(sales: DataFrame) -> DataFrame:
    """One row of each (market, combination, time, price to six decimals): that with the least id."""
    keys = [*("market", "collection", "model", "backdrop", "sold_at"), F.round("price", 6).alias("price")]
    return sales.groupBy(*keys).agg(F.min("sale_id").alias("sale_id"))


def newest(sales: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The ``n`` newest of each key; ties to the smaller id. Rows beyond rank n are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("sold_at").desc(), "sale_id")
    return sales.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def newest_merged(sales: DataFrame, keys: list[str], source: str = "market", n: int = 5) -> DataFrame:
    """The newest of each source, then the newest of those."""
    return newest(newest(sales, [*keys, source], n).drop("rank"), keys, n)


def last_sale(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Price and time of the newest positive sale of each key; of equal times, the smaller id."""
    ranked = F.struct(F.unix_micros("sold_at").alias("t"), "sale_id")
    newest_at = sales.where("price > 0").groupBy(*keys).agg(F.max("sold_at").alias("sold_at"))
    return sales.where("price > 0").join(newest_at, [*keys, "sold_at"]).groupBy(*keys).agg(F.min_by(F.struct("price", "sold_at", "sale_id"), ranked).alias("x")).select(*keys, F.col("x.price").alias("last_price"), F.col("x.sold_at").alias("last_sold_at"), F.col("x.sale_id").alias("last_sale_id"))


def daily_low(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest price of each UTC day; keys with fewer than two days are left out."""
    days = sales.where("price > 0").groupBy(*keys, F.to_date("sold_at").alias("day")).agg(F.min("price").alias("low"), F.count("*").alias("sold"))
    many = days.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n >= 2").drop("__n")
    return days.join(many, keys, "left_semi")


def day_figures(sales: DataFrame, keys: list[str], as_of: Column, hours: int = 24) -> DataFrame:
    inside = (F.col("sold_at") > as_of - F.expr(f"interval {hours} hours")) & (F.col("sold_at") <= as_of)
    return sales.groupBy(*keys).agg(F.count_if(inside).alias("sales"), F.coalesce(F.sum(F.when(inside, F.col("price"))), F.lit(0.0)).alias("volume"))


def beyond_watermark(pages: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New sales only: newer than what is stored of their key, or of its newest time but another id; repeated ids once."""
    marks = stored.groupBy(*keys).agg(F.max("sold_at").alias("__mark"))
    fresh = pages.join(marks, keys, "left").where(F.col("__mark").isNull() | (F.col("sold_at") >= F.col("__mark"))).drop("__mark")
    return fresh.dropDuplicates(["sale_id"]).join(stored.select("sale_id"), "sale_id", "left_anti").select(*pages.columns)
