"""Sales and listings as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_sales(sales: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each sale once, by id, within the watermark; the state of ids older than it is dropped."""
    return sales.withWatermark("sold_at", delay).dropDuplicatesWithinWatermark(["sale_id"])


def daily_floors(sales: DataFrame, delay: str = "1 day") -> DataFrame:
    """Lowest price and count of each collection and UTC day, appended once the day can't change any more."""
    return new_sales(sales, delay).groupBy(F.window("sold_at", "1 day").alias("w"), "collection").agg(F.min("price").alias("low"), F.count("*").alias("sold")).select("collection", F.to_date("w.start").alias("day"), "low", "sold")
