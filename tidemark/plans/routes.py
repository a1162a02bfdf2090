"""What the application serves, as compositions of operators; each takes landed tables and an ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import holdings as H
from tidemark.operators import registry as R
from tidemark.operators import sales as S
from tidemark.operators import series as T
from tidemark.operators import valuation as V


def wallet_tokens(primary: DataFrame, secondary: DataFrame, rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two providers' balances merged, priced and passed through the quality gate."""
    return H.gate(H.enrich(H.merge_inventories(primary, secondary), rates, pairs))


def wallet_collectibles(holdings: DataFrame, listings: DataFrame, sales: DataFrame, traits: DataFrame, rate: Column) -> DataFrame:
    """Holdings valued by exact floor, last exact sale or estimate.

    ``traits`` has collection, trait_type, value and rarity in percent. Estimates are made for the combinations that are
    missing or thin, each once.
    """
    floors = R.combo_floor(listings)
    last = S.last_sale(sales, R.COMBO)
    open_ = R.missing(holdings, floors.where(~R.thin(F.col("floor"), F.col("listed"))), R.COMBO)
    by = lambda kind, name: traits.where(F.col("trait_type") == kind).select("collection", F.col("value").alias(kind), F.col("rarity").alias(name))
    rated = lambda d: d.join(by("model", "model_rarity"), ["collection", "model"], "left").join(by("backdrop", "backdrop_rarity"), ["collection", "backdrop"], "left").na.fill(0.0, ["model_rarity", "backdrop_rarity"])
    pairs = rated(open_).withColumn("pair_id", F.xxhash64(*R.COMBO))
    return V.cascade(holdings, floors, last, V.estimate(pairs, rated(floors)), rate, R.COMBO)


def bulk_floors(pairs: DataFrame, listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Floors of the requested combinations, with status priced, thin or pending; with ``limit``, of the first so many."""
    asked = pairs.where("model <> '' and backdrop <> ''").select(*R.COMBO).distinct()
    asked = asked if limit is None else asked.orderBy(*R.COMBO).limit(limit)
    found = asked.join(R.combo_floor(listings), R.COMBO, "left")
    return found.withColumn("status", F.when(F.col("floor").isNull(), "pending").when(R.thin(F.col("floor"), F.col("listed")), "thin").otherwise("priced"))


def portfolio_summary(tokens: DataFrame, collectibles: DataFrame) -> DataFrame:
    """One row: value and number of tokens and collectibles, and how many are unpriced."""
    t = tokens.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("token_value"), F.count_if(F.col("balance") > 0).alias("tokens"))
    c = collectibles.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("collectible_value"), F.count("*").alias("collectibles"), F.count_if(F.col("status") == "unavailable").alias("unpriced"))
    return t.crossJoin(c).withColumn("total_value", F.col("token_value") + F.col("collectible_value"))  # one row each


def wallet_history(moves: DataFrame, quotes: DataFrame, as_of: Column, days: int = 31) -> DataFrame:
    """The highest value of each wallet and day over the last days, from the ledger and the nearest prices."""
    grid = T.daily_grid(moves.sparkSession.range(1), as_of, days)
    points = T.portfolio(T.trim_grid(grid, moves, as_of), moves, quotes)
    return T.peaks(points, ["wallet", "bucket"])


def asset_detail(pairs: DataFrame, listings: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """Floor, listings, last sale, day figures and daily lows of requested combinations."""
    sold = sales.join(pairs.select(*R.COMBO).distinct(), R.COMBO, "left_semi")
    lows = S.daily_low(sold, R.COMBO).groupBy(*R.COMBO).agg(F.array_sort(F.collect_list(F.struct("day", "low"))).alias("history"))
    out = pairs.select(*R.COMBO).distinct().join(R.combo_floor(listings), R.COMBO, "left").join(S.last_sale(sold, R.COMBO), R.COMBO, "left")
    return out.join(S.day_figures(sold, R.COMBO, as_of), R.COMBO, "left").join(lows, R.COMBO, "left")
