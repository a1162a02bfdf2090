"""Feeds of several sources brought to one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consolidated(rows: DataFrame, key: str, fields: list[str], rank: str = "source_rank", source: str = "source") -> DataFrame:
    """One row per key: each field's first value by source rank that isn't null or blank, and all sources in order."""
    first = [F.min_by(F.when(F.col(f).cast("string") != "", F.col(f)), F.when(F.col(f).cast("string") != "", F.col(rank))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*first, F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def rate_at(rates: DataFrame, as_of: Column, fresh_hours: int, constant: float) -> DataFrame:
    """One row (rate, rate_source): the best-ranked source with a fresh rate, else the newest of any, else the constant."""
    age = F.unix_micros(as_of) - F.unix_micros("at")
    usable = rates.where((F.col("rate") > 0) & (age >= 0))
    fresh = F.when(age <= fresh_hours * 3_600_000_000, F.struct("source_rank", age.alias("age")))
    g = usable.agg(F.min_by("rate", fresh).alias("a"), F.min_by("rate", age).alias("b"))
    return g.select(F.coalesce("a", "b", F.lit(constant)).alias("rate"), F.when(F.col("a").isNotNull(), "live").when(F.col("b").isNotNull(), "last").otherwise("constant").alias("rate_source"))


def activity(moves: DataFrame) -> DataFrame:
    """Movements (wallet, source, destination, kind, amount, symbol) with direction, counterparty, signed text and search text."""
    into = F.col("destination") == F.col("wallet")
    direction = F.when(F.col("kind") == "swap", "swap").when(into, "in").otherwise("out")
    other = F.when(F.col("kind") == "swap", F.lit("")).when(into, F.col("source")).otherwise(F.col("destination"))
    sign = F.when(direction == "in", "+").when(direction == "out", "-").otherwise("")
    shown = F.concat(sign, F.format_number("amount", 2), F.lit(" "), F.col("symbol"))
    return moves.withColumns({"direction": direction, "counterparty": other, "amount_text": shown, "search": F.lower(F.concat_ws(" ", direction, other, "symbol", "kind"))})


def progress(items: DataFrame, done: Column, keys: list[str]) -> DataFrame:
    """How many of each group are done, and in whole percent."""
    return items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(done).alias("done")).withColumn("percent", F.floor(F.col("done") / F.col("total") * 100 + 0.5))


def plausible_floor(usd: Column, native: Column, most_usd: float = 10_000.0, most_native: float = 5_000.0) -> Column:
    """Both within bounds and one positive."""
    u, n = F.coalesce(usd, F.lit(0.0)), F.coalesce(native, F.lit(0.0))
    return (u <= most_usd) & (n <= most_native) & ((u > 0) | (n > 0))


def plausible_price(price: Column, provider: Column, low: float = 0.2, high: float = 5.0) -> Column:
    """Whether a price is within a ratio of the provider's own; true where either is missing or not positive."""
    return F.when((price > 0) & (provider > 0), F.try_divide(price, provider).between(low, high)).otherwise(True)


def demand(change: Column, threshold: float = 20.0) -> Column:
    return F.when(change >= threshold, "rising").when(change <= -threshold, "falling").otherwise("steady")


def agrees(last: Column, current: Column, tolerance: float = 0.35) -> Column:
    """Whether a history's last point is within a relative tolerance of the current value."""
    return F.coalesce((current > 0) & (F.abs(last - current) / current <= tolerance), F.lit(False))
