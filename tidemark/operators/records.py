"""Records from landed payloads (VARIANT), one select per shape: floors, models, attributes, tokens, items, sales, points.

Throughout: of several candidate paths the first counts that is there and, for numbers, not zero, for texts, not empty.
Numbers may come as numbers or as numeric texts; what is neither counts as absent. Absent numbers are 0 and absent texts
empty, unless said otherwise. Rows whose payload is null or of another shape give no records from its lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.sources import plausible_floor

TRAITS = ("Model", "Backdrop", "Symbol")


def _path(p: str) -> str:
    return "$" + ("." if p and p[0] != "[" else "") + p


def number(payload: Column, *paths: str) -> Column:
    """First number that is not zero, else 0."""
    found = [F.try_variant_get(payload, _path(p), "double") for p in paths]
    return F.coalesce(*[F.when((v != 0) & ~F.isnan(v), v) for v in found], F.lit(0.0))


def present(payload: Column, *paths: str) -> Column:
    """First number that is there, zero or not, else 0."""
    return F.coalesce(*[F.try_variant_get(payload, _path(p), "double") for p in paths], F.lit(0.0))


def string(payload: Column, *paths: str, default: str = "") -> Column:
    """First text that is not empty."""
    found = [F.try_variant_get(payload, _path(p), "string") for p in paths]
    return F.coalesce(*[F.when(v != "", v) for v in found], F.lit(default))


def items(payload: Column, *paths: str) -> Column:
    """First list that is there, as an array of VARIANT."""
    return F.coalesce(*[F.try_variant_get(payload, _path(p), "array<variant>") for p in paths], F.expr("cast(array() as array<variant>)"))


def moment(payload: Column, *paths: str) -> Column:
    """Timestamp of the first path that has one: milliseconds beyond 1e12, else seconds; or a text that can be read as a time."""
    read = [(F.try_variant_get(payload, _path(p), "double"), F.try_variant_get(payload, _path(p), "string").try_cast("timestamp")) for p in paths]
    return F.coalesce(*[F.coalesce(F.timestamp_millis(F.when(n > 1e12, n).otherwise(n * 1000).cast("long")), t) for n, t in read])


def _rate(given: Column, native: Column, usd: Column) -> Column:
    return F.when(given > 0, given).when(native > 0, usd / native).otherwise(0.0)


def floor_records(rows: DataFrame) -> DataFrame:
    """(name, payload) to one snapshot record each; none without a positive floor or with an empty key."""
    p = F.col("payload")
    r = rows.select(F.coalesce(F.nullif(string(p, "canonicalName"), F.lit("")), F.col("name")).alias("name"), number(p, "floorTon").alias("floor_native"), number(p, "floorUsd").alias("floor_usd"), number(p, "tonUsdRate").alias("usd_rate"), string(p, "source", "marketPlatform", default="xgift").alias("source"), number(p, "listedCount").cast("long").alias("listed"), number(p, "totalSupply").cast("long").alias("supply"), number(p, "holders").cast("long").alias("holders"), number(p, "volume24hUsd").alias("volume_24h_usd"), number(p, "change24hPct").alias("change_24h"))
    r = r.withColumn("collection_key", text.key(F.col("name"))).withColumn("usd_rate", _rate(F.col("usd_rate"), F.col("floor_native"), F.col("floor_usd")))
    return r.where("collection_key <> '' and (floor_native > 0 or floor_usd > 0)")


def model_records(rows: DataFrame) -> DataFrame:
    """(name, payload) to one record per model of ``payload.models`` with a name and a positive floor."""
    p, m = F.col("payload"), F.col("m")
    name = F.coalesce(F.nullif(string(p, "canonicalName"), F.lit("")), F.col("name"))
    each = rows.select(name.alias("collection"), number(p, "tonUsdRate").alias("__rate"), string(p, "source", "marketPlatform", default="xgift").alias("source"), F.explode(items(p, "models")).alias("m"))
    native, usd = number(m, "floorTon"), number(m, "floorUsd")
    own = number(m, "tonUsdRate")
    r = each.select("collection", text.key(F.col("collection")).alias("collection_key"), F.trim(string(m, "model")).alias("model"), native.alias("floor_native"), usd.alias("floor_usd"), _rate(F.when(own > 0, own).otherwise(F.col("__rate")), native, usd).alias("usd_rate"), "source", number(m, "listedCount").cast("long").alias("listed"), number(m, "modelCount").cast("long").alias("supply"), number(m, "rarity").alias("rarity"), string(m, "mediaType").alias("media"))
    r = r.withColumn("model_key", text.key(F.col("model")))
    return r.where("collection_key <> '' and model_key <> '' and (floor_native > 0 or floor_usd > 0)")


def attribute_records(rows: DataFrame) -> DataFrame:
    """(name, payload) with lists models, backdrops and symbols (or patterns) to long rows; entries without a name are left out.

    Floors come in billionths; rarity is a percentage, given as such or per thousand.
    """
    p, a = F.col("payload"), F.col("a")
    lists = [items(p, "models"), items(p, "backdrops"), items(p, "symbols", "patterns")]

    def labelled(trait_type: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(trait_type).alias("t"), v.alias("v")))

    typed = F.flatten(F.array(*map(labelled, TRAITS, lists)))
    each = rows.select("name", F.explode(typed).alias("x")).select("name", F.col("x.t").alias("trait_type"), F.col("x.v").alias("a"))
    per_mille = number(a, "rarity_per_mille", "rarityPerMille")
    r = each.select(F.col("name").alias("collection"), text.key(F.col("name")).alias("collection_key"), "trait_type", F.trim(string(a, "name", "value", "title")).alias("value"), F.when(per_mille > 0, per_mille / 10).otherwise(number(a, "rarity")).alias("rarity"), present(a, "stats.count", "count", "total").cast("long").alias("item_count"), (present(a, "stats.floor", "floor") / 1e9).alias("floor_native"))
    return r.where("value <> ''").withColumn("value_key", text.key(F.col("value")))


def catalog_models(rows: DataFrame, rate: float) -> DataFrame:
    """(name, payload) to model floors from a catalogue's ``models``; without a positive floor or a name there is none."""
    m = F.col("m")
    each = rows.select("name", F.explode(items(F.col("payload"), "models")).alias("m"))
    r = each.select(F.col("name").alias("collection"), F.trim(string(m, "name")).alias("model"), (number(m, "stats.floor") / 1e9).alias("floor_native"), number(m, "stats.count").cast("long").alias("listed"), (number(m, "rarity_per_mille") / 10).alias("rarity"), text.media_kind(string(m, "animation_url", "video_url", "animated_url", "image_url")).alias("media"))
    return r.where("floor_native > 0 and model <> ''").withColumn("floor_usd", F.col("floor_native") * rate)


def requested_pairs(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests (collection, model, backdrop, symbol) trimmed, with their keys and the collection's alias keys; blank ones go.

    ``limit`` is a service's cap on a request, in no order of its own; none by default.
    """
    names = ["collection", "model", "backdrop", "symbol"]
    r = (pairs if limit is None else pairs.limit(limit)).select(*[F.trim(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names])
    r = r.withColumns({f"{n}_key": text.key(F.col(n)) for n in names}).withColumn("collection_keys", text.registry_alias_keys(F.col("collection")))
    return r.where("collection_key <> '' and model_key <> ''")


def _trait(payload: Column, label: str) -> Column:
    hit = F.filter(items(payload, "attributes", "metadata.attributes"), lambda t: F.lower(string(t, "label", "trait_type")) == label)
    return F.get(hit, 0)


def percent(shown: Column) -> Column:
    """The first number of a text such as "1.5%"; 0 without one."""
    return F.coalesce(F.regexp_extract(shown, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def holding_pairs(rows: DataFrame) -> DataFrame:
    """(asset_id, payload) of holdings to their combination with rarities in percent; those without model or backdrop go."""
    p = F.col("payload")
    r = rows.select("asset_id", F.trim(string(p, "collection", "name")).alias("collection"), *[_trait(p, t).alias(t) for t in ("model", "backdrop", "symbol")])
    out = r.select("asset_id", "collection", *[F.trim(string(F.col(t), "value")).alias(t) for t in ("model", "backdrop", "symbol")], *[percent(string(F.col(t), "rarity", "rarityPercent")).alias(f"{t}_rarity") for t in ("model", "backdrop", "symbol")])
    return out.where("collection <> '' and model <> '' and backdrop <> ''")


def token_balances(rows: DataFrame) -> DataFrame:
    """(wallet, payload) to one row per entry of ``balances``; amounts are scaled by the token's decimals, 9 if not given."""
    b = F.col("b")
    each = rows.select("wallet", F.explode(items(F.col("payload"), "balances")).alias("b"))
    decimals = F.coalesce(F.nullif(number(b, "jetton.decimals"), F.lit(0.0)), F.lit(9.0))
    r = each.select("wallet", string(b, "jetton.address").alias("address"), string(b, "jetton.name", default="Unknown Jetton").alias("name"), string(b, "jetton.symbol", default="JETTON").alias("symbol"), decimals.cast("int").alias("decimals"), (number(b, "balance") / F.pow(F.lit(10.0), decimals)).alias("balance"), string(b, "jetton.verification", default="none").alias("verification"), number(b, "price.prices.USD", "priceUsd").alias("price_usd"))
    return r.withColumn("value_usd", F.col("balance") * F.col("price_usd"))


def indexed_balances(rows: DataFrame) -> DataFrame:
    """(wallet, payload) of the second provider, entries of ``jetton_wallets``; only those with an address and a positive balance."""
    b = F.col("b")
    each = rows.select("wallet", F.explode(items(F.col("payload"), "jetton_wallets")).alias("b"))
    decimals = F.coalesce(F.nullif(number(b, "metadata.decimals", "jetton.decimals", "decimals"), F.lit(0.0)), F.lit(9.0))
    r = each.select("wallet", string(b, "metadata.address", "jetton_address", "jetton", "jetton.address").alias("address"), string(b, "metadata.name", "jetton.name", "symbol", default="Unknown Jetton").alias("name"), string(b, "metadata.symbol", "jetton.symbol", "symbol", default="JETTON").alias("symbol"), decimals.cast("int").alias("decimals"), (number(b, "balance") / F.pow(F.lit(10.0), decimals)).alias("balance"), string(b, "metadata.verification", default="none").alias("verification"))
    return r.where("address <> '' and balance > 0")


def accounts(rows: DataFrame) -> DataFrame:
    """(address, payload) to a header each: balance, status, and whether it is a wallet."""
    p = F.col("payload")
    wallet = F.exists(items(p, "interfaces"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string") == "wallet", F.lit(False)))
    return rows.select("address", text.short_address(F.col("address")).alias("shown"), (number(p, "balance") / 1e9).alias("balance"), string(p, "status", default="unknown").alias("status"), wallet.alias("is_wallet"))


def market_items(rows: DataFrame, rate: float) -> DataFrame:
    """(payload) of a marketplace's items; a sale price over a million is in billionths."""
    p = F.col("payload")
    sale = number(p, "sale.price")
    floor = number(p, "sale.price", "listing.price", "floorPrice", "collection.floorPrice") / F.when(sale > 1e6, 1e9).otherwise(1.0)
    there = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(p, f"$.{n}", "variant")) != "VOID", F.lit(False))
    listed = there("sale") | there("listing") | F.coalesce(F.try_variant_get(p, "$.isOnSale", "boolean"), F.lit(False))
    return rows.select(string(p, "name", "metadata.name", default="Collectible").alias("name"), string(p, "collection.name", "collectionInfo.name", default="Telegram Collectible").alias("collection"), string(p, "address", "id").alias("address"), text.media_kind(string(p, "animation_url", "animationUrl", "metadata.animation_url", "metadata.video_url")).alias("media"), floor.alias("floor_native"), (floor * rate).alias("floor_usd"), (number(p, "lastSale.price") / 1e9).alias("last_sale_native"), listed.alias("listed"))


def wallet_items(rows: DataFrame) -> DataFrame:
    """(wallet, payload) of items held: names, where its image is from, and whether it is verified."""
    p = F.col("payload")
    collection = string(p, "collection.name", default="Unknown collection")
    image, about = string(p, "metadata.image"), F.concat_ws(" ", collection, string(p, "metadata.name"), string(p, "metadata.description"))
    source = F.when(image.rlike("(?i)goodies-api-prod"), "Goodies").when(image.rlike("(?i)stickerdom"), "Stickerdom").when(F.concat_ws(" ", image, about).rlike("(?i)ton-of-memes|good vibes club|gold vibes club|the meme ogs|tapps"), "Fuse").otherwise("")
    verified = (F.size(items(p, "approved_by")) > 0) | F.coalesce(F.try_variant_get(p, "$.verified", "boolean"), F.lit(False))
    return rows.select("wallet", string(p, "address").alias("address"), F.coalesce(F.nullif(string(p, "metadata.name"), F.lit("")), collection).alias("name"), collection.alias("collection"), source.alias("source"), string(p, "owner.address").alias("owner"), verified.alias("verified"), number(p, "index").cast("long").alias("mint"))


def feed_sales(rows: DataFrame, rate: float) -> DataFrame:
    """(payload) of a history feed to sales with a positive price, in units or billionths."""
    p = F.col("payload")
    candidates = [number(p, "price.ton"), number(p, "ton"), number(p, "nanoton") / 1e9, number(p, "price.nanoton") / 1e9]
    price = F.coalesce(*[F.when(c > 0, c) for c in candidates], F.lit(0.0))
    r = rows.select(price.alias("price"), string(p, "seen_at", "updated_at", "date", "timestamp").alias("sold_at"), string(p, "market", "marketplace", "source", default="see.tg").alias("market"), string(p, "owner.username", "owner.name", "owner_id").alias("buyer"), string(p, "prev_owner.username", "prev_owner.name", "prev_owner_id").alias("seller"), number(p, "num", "number").cast("long").alias("mint"), string(p, "model_name").alias("model"), string(p, "backdrop_name").alias("backdrop"), string(p, "pattern_name", "symbol_name").alias("symbol"))
    return r.where("price > 0").withColumn("price_usd", F.col("price") * rate)


def worker_sales(rows: DataFrame, fallback: str = "") -> DataFrame:
    """(payload) to sales of whole combinations with a readable time; without an id, one is made of seven fields."""
    p = F.col("payload")
    of = lambda *n: F.trim(string(p, *n))
    r = rows.select(F.coalesce(F.nullif(of("collectionName", "collection"), F.lit("")), F.lit(fallback)).alias("collection"), of("modelName", "model").alias("model"), of("backdropName", "backdrop").alias("backdrop"), of("symbolName", "symbol").alias("symbol"), of("market", "marketplace").alias("market"), of("slug").alias("slug"), number(p, "normalizedPrice").alias("price"), of("soldAt", "date").alias("__sold"), string(p, "_id", "id").alias("__id"), string(p, "normalizedPrice").alias("__shown"))
    made = F.concat_ws("|", "collection", "model", "backdrop", "market", "slug", "__sold", "__shown")
    r = r.withColumns({"sale_id": F.when(F.col("__id") != "", F.col("__id")).otherwise(made), "sold_at": F.col("__sold").try_cast("timestamp")})
    return r.where("collection <> '' and model <> '' and backdrop <> '' and price > 0 and sold_at is not null").drop("__sold", "__id", "__shown")


def chart_points(rows: DataFrame, key: str = "token") -> DataFrame:
    """(key, payload) of a chart to points with a time and a positive price; entries are pairs or objects. Times over 1e12 are milliseconds."""
    e = F.col("e")
    each = rows.select(key, F.explode(items(F.col("payload"), "", "prices", "points", "data", "items", "chart")).alias("e"))
    pair = lambda i: F.try_variant_get(e, f"$[{i}]", "double")
    at = F.coalesce(pair(0), *[F.try_variant_get(e, f"$.{n}", "double") for n in ("timestamp", "time", "t", "date")])
    price = F.coalesce(pair(1), *[F.try_variant_get(e, f"$.{n}", "double") for n in ("price", "value", "close", "c")])
    r = each.select(key, F.timestamp_millis(F.when(at > 1e12, at).otherwise(at * 1000).cast("long")).alias("at"), price.alias("price"))
    return r.where("at is not null and price > 0 and not isnan(price)")


def floor_points(rows: DataFrame, as_of: Column, key: str = "asset_id") -> DataFrame:
    """(key, payload, floor_native, floor_usd) of a detail page to its history; dollars are given or come from the rate.

    The rate is the payload's, or that of its floor, or of the asset. A point without a time counts back from ``as_of`` by days.
    """
    p, e = F.col("payload"), F.col("e")
    history = items(p, "floorHistory")
    own = _rate(number(p, "floor.tonUsdRate"), number(p, "floor.floorTon"), number(p, "floor.floorUsd"))
    rate = F.when(own > 0, own).otherwise(_rate(F.lit(0.0), F.col("floor_native"), F.col("floor_usd")))
    each = rows.select(key, rate.alias("__rate"), F.size(history).alias("__n"), F.posexplode(history).alias("__i", "e"))
    native, usd = number(e, "priceTon", "ton", "floorTon"), number(e, "priceUsd", "usd", "floorUsd")
    at = F.coalesce(moment(e, "timestamp", "date"), F.timestamp_micros(F.unix_micros(as_of) - (F.col("__n") - 1 - F.col("__i")).cast("long") * 86_400_000_000))
    r = each.select(key, at.alias("at"), F.when(usd > 0, usd).otherwise(native * F.col("__rate")).alias("price_usd"), native.alias("price_native"))
    return r.where("price_usd > 0")


def wallet_points(rows: DataFrame, key: str = "wallet") -> DataFrame:
    """(key, payload) of a wallet's history to points with a finite value and a time."""
    e = F.col("e")
    value = F.try_variant_get(e, "$.valueUsd", "double")
    r = rows.select(key, F.explode(items(F.col("payload"), "", "points")).alias("e")).select(key, moment(e, "timestamp").alias("at"), value.alias("value"))
    return r.where("value is not null and not isnan(value) and abs(value) < double('inf') and at is not null")


def imported_tokens(rows: DataFrame, rate: float) -> DataFrame:
    """(wallet, payload) to its native balance, if positive, and its tokens; a missing price comes from value and balance."""
    p, t = F.col("payload"), F.col("t")
    held = present(p, "assets.ton.balance", "summary.tonBalance")
    native = rows.select("wallet", held.alias("balance")).where("balance > 0").select("wallet", F.lit("").alias("address"), F.lit("TON").alias("symbol"), "balance", F.lit(float(rate)).alias("price_usd"), (F.col("balance") * rate).alias("value_usd"), F.lit(True).alias("trusted"))
    each = rows.select("wallet", F.posexplode(items(p, "assets.jettons")).alias("i", "t"))
    balance, value = number(t, "balance"), number(t, "valueUsd")
    given = number(t, "priceUsd")
    price = F.when(given > 0, given).when(balance != 0, value / balance).otherwise(0.0)
    symbol = F.coalesce(F.nullif(string(t, "symbol"), F.lit("")), F.concat(F.lit("JET"), (F.col("i") + 1).cast("string")))
    return native.unionByName(each.select("wallet", string(t, "address").alias("address"), symbol.alias("symbol"), balance.alias("balance"), price.alias("price_usd"), F.when(value != 0, value).otherwise(balance * price).alias("value_usd"), (F.lower(string(t, "verification")) == "whitelist").alias("trusted")))


def item_prices(rows: DataFrame, rate: float, key: str = "item") -> DataFrame:
    """(key, payload) of an item's statistics to its price and day's change; implausible or missing floors give none."""
    p = F.col("payload")
    usd = number(p, "current.price.floor.usd", "current.price.median.usd")
    given = number(p, "current.price.floor.ton", "current.price.median.ton")
    native = F.when(given > 0, given).otherwise(usd / rate if rate > 0 else F.lit(0.0))
    before = F.coalesce(F.nullif(number(p, "volume24h.price.floor.usd", "['24h'].price.floor.usd"), F.lit(0.0)), usd)
    r = rows.select(key, native.alias("floor_native"), F.when(usd > 0, usd).otherwise(native * rate).alias("floor_usd"), F.when(before > 0, (usd - before) / before * 100).otherwise(0.0).alias("change_24h"), number(p, "volume24h.trades", "['24h'].trades").cast("long").alias("sales_24h"), number(p, "supply.current", "supply.initial").cast("long").alias("supply"))
    return r.where(plausible_floor(F.col("floor_usd"), F.col("floor_native")))


def transactions(rows: DataFrame) -> DataFrame:
    """(payload) of transactions: ends, amount and fee in units, time and status."""
    p = F.col("payload")
    failed = F.coalesce(F.try_variant_get(p, "$.description.aborted", "boolean"), F.lit(False))
    return rows.select(string(p, "hash").alias("hash"), string(p, "in_msg.source", "account").alias("sender"), string(p, "in_msg.destination", "account").alias("recipient"), (number(p, "in_msg.value") / 1e9).alias("amount"), (number(p, "total_fees") / 1e9).alias("fee"), moment(p, "now").alias("at"), F.when(failed, "Failed").otherwise("Success").alias("status"))
