"""What a detail page and a scan ask for: provenance, best matches, floors by freshness, histories from sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.series import HOUR, nearest_price

SECOND = 1_000_000


def with_ledger_tokens(current: DataFrame, moves: DataFrame, keys: list[str], token: str = "token", at: str = "at") -> DataFrame:
    """Tokens held now, and those that only the ledger knows, with a balance of 0 and the symbol of their first movement."""
    known = moves.where(F.col(token).cast("string") != "").groupBy(*keys, token).agg(F.min_by("symbol", F.struct(at, "symbol")).alias("symbol"))
    gone = known.join(current, [*keys, token], "left_anti")
    held = current.select(*keys, token, "symbol", F.col("balance").cast("double").alias("balance"))
    return held.unionByName(gone.select(*keys, token, F.coalesce("symbol", F.lit("JETTON")).alias("symbol"), F.lit(0.0).alias("balance")))


def last_inbound(transfers: DataFrame, owner: str = "wallet", asset: str = "asset", at: str = "at", ordinal: str = "event_id") -> DataFrame:
    """Who sent each asset to its owner last, and when; assets that never came in have no row."""
    came = transfers.where(F.col("destination") == F.col(owner))
    return came.groupBy(owner, asset).agg(F.max_by(F.struct("source", F.col(at).alias("received_at")), F.struct(at, ordinal)).alias("x")).select(owner, asset, "x.*")


def best_scored(requests: DataFrame, rows: DataFrame, key: str = "request_id", ordinal: str = "ord") -> DataFrame:
    """Of the rows answered to each request, the one that scores highest; ties to the earlier. Requests without rows are left out.

    An equal alias of the name gives 5 and a containing one 3; model, backdrop and symbol give 3, 2 and 1. ``rows`` has
    the request's key, ordinal, title and row_model, row_backdrop, row_symbol; ``requests`` has an array of aliases.
    """
    names, title = F.col("aliases"), F.col("title")
    score = F.when(text.alias_matches(names, title), 5).when(text.alias_includes(names, title), 3).otherwise(0)
    for trait, points in (("model", 3), ("backdrop", 2), ("symbol", 1)):
        same = (F.col(trait) != "") & (text.alias(F.col(trait)) == text.alias(F.col(f"row_{trait}")))
        score = score + F.when(same, points).otherwise(0)
    scored = rows.join(requests, key).withColumn("score", score)
    best = F.min_by(F.struct(ordinal, "title", "score"), F.struct((-F.col("score")).alias("s"), ordinal)).alias("x")
    return scored.groupBy(key).agg(best).select(key, "x.*")


def floor_from_sales(sales: DataFrame, floors: DataFrame, keys: list[str], as_of: Column, days: int = 7) -> DataFrame:
    """(keys, at, price): the cheapest sale of each day, then the current floor; series of one point are left out.

    A point less than a second after the one before only replaces its price. ``floors`` has keys and floor. A series has
    at most ``days`` + 2 points, so it is merged in an array.
    """
    inside = sales.where((F.col("price") > 0) & (F.col("sold_at") >= as_of - F.expr(f"interval {days} days")) & (F.col("sold_at") <= as_of))
    t = F.unix_micros("sold_at")
    lows = inside.groupBy(*keys, F.to_date("sold_at").alias("day")).agg(F.min_by(F.struct(t.alias("t"), F.lit(0).alias("now"), F.col("price").cast("double").alias("price")), F.struct("price", "sold_at")).alias("x"))
    current = floors.where("floor > 0").select(*keys, F.struct(F.unix_micros(as_of).alias("t"), F.lit(1).alias("now"), F.col("floor").cast("double").alias("price")).alias("x"))
    series = lows.select(*keys, "x").unionByName(current).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.struct(last["t"].alias("t"), last["now"].alias("now"), x["price"].alias("price"))
        return F.when((F.size(acc) > 0) & (x["t"] - F.try_element_at(acc, F.lit(-1))["t"] < SECOND), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    points = series.withColumn("ps", F.aggregate("xs", F.filter("xs", lambda x: F.lit(False)), step)).where(F.size("ps") >= 2)
    return points.select(*keys, F.explode("ps").alias("p")).select(*keys, F.timestamp_micros("p.t").alias("at"), "p.price")


def floor_by_freshness(pairs: DataFrame, registry: DataFrame, stored: DataFrame, live: DataFrame, keys: list[str], as_of: Column, fresh_hours: float = 3) -> DataFrame:
    """``pairs`` with floor and source: the registry's, else one stored less than ``fresh_hours`` ago, else a live one, else any stored.

    The three have keys and floor, ``stored`` also sampled_at; of several stored, the newest.
    """
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct("floor", "sampled_at"), F.struct("sampled_at", "floor")).alias("__s"))
    out = pairs
    for name, side in (("__r", registry), ("__l", live)):
        out = out.join(side.where("floor > 0").groupBy(*keys).agg(F.min("floor").alias(name)), keys, "left")
    out = out.join(newest.where("__s.floor > 0"), keys, "left")
    fresh = F.unix_micros(as_of) - F.unix_micros("__s.sampled_at") < int(fresh_hours * HOUR)
    source = F.when(F.col("__r").isNotNull(), "registry").when(fresh, "stored").when(F.col("__l").isNotNull(), "live").when(F.col("__s").isNotNull(), "stale")
    floor = F.when(source == "registry", F.col("__r")).when(source == "live", F.col("__l")).otherwise(F.col("__s.floor"))
    return out.withColumns({"floor": floor.cast("double"), "floor_source": source}).drop("__r", "__l", "__s")


def to_scan(collections: DataFrame, registry: DataFrame, key: str, version: int, as_of: Column, fresh_hours: float = 12) -> DataFrame:
    """Collections that no scanner of this version has scanned in the last ``fresh_hours``."""
    fresh = registry.where((F.col("version") == version) & (F.unix_micros(as_of) - F.unix_micros("snapshot_at") <= int(fresh_hours * HOUR)))
    return collections.join(fresh.select(key).distinct(), key, "left_anti")


def balance_change(moves: DataFrame, start: Column, end: Column, key: str = "wallet") -> DataFrame:
    """Sum of the movements after ``start`` up to ``end``; 0 for those without any in between."""
    inside = (F.col("at") > start) & (F.col("at") <= end)
    return moves.groupBy(key).agg(F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0.0)).alias("change"))


def held_value_history(grid: DataFrame, holdings: DataFrame, quotes: DataFrame, rate: Column, max_stale_hours: float | None = None, key: str = "wallet") -> DataFrame:
    """What is held now, at the native prices of the grid's times: (key, bucket, at, price, value).

    ``holdings`` has key, balance and token_value, which stays as it is; ``rate`` stands in for times without a price.
    """
    probes = holdings.select(key, "balance", "token_value").crossJoin(F.broadcast(grid))  # a grid has at most a few hundred rows
    priced = nearest_price(probes, quotes, key, max_stale_hours, rate)
    return priced.withColumn("value", F.col("balance") * F.col("price") + F.col("token_value")).drop("balance", "token_value")


def mentions_token(searched: Column, addresses: Column, address: Column, symbol: Column, name: Column) -> Column:
    """Whether an activity is about a token: by its address, its symbol as a word, or its name as words if over three letters.

    The native symbol TON is looked for as a word alone, never by name.
    """
    said = F.coalesce(searched, F.lit(""))
    as_words = lambda c: F.regexp_like(said, F.concat(F.lit("(?i)(^|[^A-Za-z0-9])"), text.escape_regex(c), F.lit("([^A-Za-z0-9]|$)")))
    a, s, n = (F.trim(F.coalesce(c, F.lit(""))) for c in (address, symbol, name))
    by_address = (a != "") & F.contains(F.lower(F.coalesce(addresses, F.lit(""))), F.lower(a))
    by_words = ((s != "") & as_words(s)) | ((F.length(n) > 3) & as_words(n))
    return F.when(by_address, True).when(F.upper(s) == "TON", F.regexp_like(said, F.lit(r"(?i)\bTON\b"))).otherwise(by_words)
