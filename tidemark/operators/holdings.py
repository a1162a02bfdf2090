"""Tokens and collectibles held: merges, quality gate, classes, filters, orders, groups and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers, text

#: Thresholds of the quality gate, in dollars and counts a day.
LARGE_VALUE, HUGE_VALUE = 100.0, 50_000.0
STALE_VOLUME, STALE_TRADES = 5.0, 3
HUGE_LIQUIDITY, HUGE_VOLUME, HUGE_TRADES = 25_000.0, 1_000.0, 10
MIN_LIQUIDITY = 50.0
#: Placeholder metadata.
GENERIC_NAME, GENERIC_SYMBOL = "unknown jetton", "jetton"
#: Symbols that stand for a dollar.
STABLE = ("USDT", "USD₮", "JUSDT", "USDC", "JUSDC")


def usable(name: Column, placeholder: str) -> Column:
    return F.coalesce(name, F.lit("")).rlike("\\S") & ~F.lower(F.trim(name)).isin(placeholder)


def generic(name: Column, symbol: Column) -> Column:
    """Placeholder metadata."""
    return F.coalesce(F.lower(F.trim(name)).isin(GENERIC_NAME), F.lit(False)) | F.coalesce(F.lower(F.trim(symbol)).isin(GENERIC_SYMBOL), F.lit(False))


def merge_inventories(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Full outer merge by address: names, symbols and images of the second where usable, the larger balance, the first's
    verification unless it has none. Both have address, name, symbol, image, balance, verification."""
    p, s = primary.alias("p"), secondary.alias("s")
    j = p.join(s, "address", "full")
    pick = lambda c, bad: F.when(usable(F.col(f"s.{c}"), bad), F.col(f"s.{c}")).otherwise(F.coalesce(f"p.{c}", f"s.{c}"))
    image = F.coalesce(F.when(F.col("s.image") != "", F.col("s.image")), F.col("p.image"))
    trust = F.coalesce(F.when(F.coalesce("p.verification", F.lit("none")) != "none", F.col("p.verification")), F.col("s.verification"), F.col("p.verification"))
    return j.select("address", pick("name", GENERIC_NAME).alias("name"), pick("symbol", GENERIC_SYMBOL).alias("symbol"), image.alias("image"), F.greatest("p.balance", "s.balance").alias("balance"), trust.alias("verification"))


def dedupe(tokens: DataFrame, ordinal: str = "ord") -> DataFrame:
    """One row per address: largest balance, first positive price and value, first usable name and symbol in order."""
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col(ordinal)))
    return tokens.groupBy("address").agg(F.max("balance").alias("balance"), F.coalesce(first("price", F.col("price") > 0), F.lit(0.0)).alias("price"), F.coalesce(first("value", F.col("value") > 0), F.lit(0.0)).alias("value"), first("name", usable(F.col("name"), GENERIC_NAME)).alias("name"), first("symbol", usable(F.col("symbol"), GENERIC_SYMBOL)).alias("symbol"))


def best_pair(pairs: DataFrame, key: str = "address") -> DataFrame:
    """The deepest pair of each token; of equal depth, the greater volume, then the smaller id."""
    t = F.struct((-F.coalesce("liquidity", F.lit(0.0))).alias("l"), (-F.coalesce("volume", F.lit(0.0))).alias("v"), "pair_id")
    return pairs.groupBy(key).agg(F.min_by(F.struct("pair_id", "price", "liquidity", "volume", "trades", "change"), t).alias("x")).select(key, "x.*")


def enrich(tokens: DataFrame, rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tokens with price and value from rates, overridden by the best market pair unless it is too shallow for an
    unverified token; adds liquidity, volume, trades and market_backed."""
    r = rates.select("address", F.col("price").alias("rate"))
    b = best_pair(pairs).select("address", F.col("price").alias("pair_price"), "liquidity", "volume", "trades", "change")
    j = tokens.join(r, "address", "left").join(b, "address", "left")
    trusted = F.lower(F.coalesce("verification", F.lit(""))) == "whitelist"
    backed = F.coalesce((F.col("pair_price") > 0) & (trusted | (F.coalesce("liquidity", F.lit(0.0)) >= MIN_LIQUIDITY)), F.lit(False))
    price = F.when(backed, F.col("pair_price")).otherwise(numbers.first_positive(F.col("rate")))
    return j.withColumns({"market_backed": backed, "price": price, "value": F.col("balance") * price}).drop("rate", "pair_price")


def quality(verification: Column, name: Column, symbol: Column, value: Column, change: Column, backed: Column, liquidity: Column, volume: Column, trades: Column) -> Column:
    """Reason of the first rule that blocks a token, else of its being allowed; blocked reasons start with '!'."""
    trusted = F.lower(F.coalesce(verification, F.lit(""))) == "whitelist"
    v, vol, liq, n = (numbers.number(c) for c in (value, volume, liquidity, trades))
    still = F.abs(F.coalesce(F.when(~F.isnan(change), change), F.lit(0.0))) < 0.01
    weak = (liq < HUGE_LIQUIDITY) | (vol < HUGE_VOLUME) | (n < HUGE_TRADES)
    return (
        F.when(F.lower(F.coalesce(verification, F.lit(""))) == "blacklist", "!blacklisted")
        .when(generic(name, symbol), "!generic-metadata")
        .when(~trusted & ~backed & (v > LARGE_VALUE) & still, "!unconfirmed-tonapi-price")
        .when(~trusted & backed & (v > LARGE_VALUE) & (vol < STALE_VOLUME) & (n < STALE_TRADES) & (change.isNull() | F.isnan(change)), "!stale-dex-price")
        .when(~trusted & backed & (v > HUGE_VALUE) & weak, "!weak-dex-market")
        .when(trusted, "verified")
        .when(backed, "unverified-but-market-backed")
        .otherwise("unpriced")
    )


def gate(tokens: DataFrame) -> DataFrame:
    """Adds quality_status and quality_reason; a blocked token has no price or value."""
    reason = quality(*[F.col(c) for c in ("verification", "name", "symbol", "value", "change", "market_backed", "liquidity", "volume", "trades")])
    g = tokens.withColumn("__q", reason).withColumn("__b", F.startswith("__q", F.lit("!")))
    zero = {c: F.when(F.col("__b"), 0.0).otherwise(F.col(c)) for c in ("price", "value")}
    return g.withColumns({**zero, "quality_status": F.when(F.col("__b"), "blocked").otherwise("allowed"), "quality_reason": F.ltrim(F.col("__q"), F.lit("!"))}).drop("__q", "__b")


def displayable(symbol: Column, name: Column, balance: Column, price: Column, value: Column, verification: Column, status: Column, native: str) -> Column:
    """What a wallet shows: the native coin if held; others held, not impostors or placeholders, not blocked, worth 0.1 or
    unpriced but verified."""
    impostor = (F.regexp_replace(F.upper(symbol), "[^A-Z0-9]", "") == native) & (symbol != native)
    shown = F.when(price > 0, value >= 0.1).otherwise(F.lower(F.coalesce(verification, F.lit(""))) == "whitelist")
    return F.coalesce(F.when(symbol == native, balance > 0).otherwise((balance > 0) & ~impostor & ~generic(name, symbol) & (F.coalesce(status, F.lit("")) != "blocked") & shown), F.lit(False))


#: Texts of offers that aren't collectibles.
SUSPICIOUS = r"unknown collection|telegram usernames?|voucher|coupon|airdrop|claim|won\s+\d|win[-.]|spin|bonus|reward|nomis ton score|nomissian|ton score|@[\w.-]+|https?://|\.me\b|\.biz\b|\.com\b|giftbox|giftboxes|scratch cards?|tmail|dns|domain"
#: Words of names of packs, known packs, and places that host their images.
PACK = r"\b(pack|stickers?|sticker collection|react pack|avatar|avatars|origins|mythics?)\b"
KNOWN_PACKS = r"\b(dogs origins|lost dogs|notcoin og|ton of memes|the meme ogs|good vibes club|gold vibes club|tapps|og icons|random memes|mememania|cool cat react pack|cool cats|doodles|snoop dogg x bayc avatars|bored ape originals|chimpers x jarritos|shib: army infantry|ruyui|gamee|city holder|moonbirds originals)\b"
HOSTS = r"stickerdom|goodies-api-prod|cdn\.city-holder|sticker"
RARITIES = "common|uncommon|rare|epic|legendary|mythic|ultimate"


def classify(collection: Column, name: Column, description: Column, trait_names: Column, trait_values: Column, image: Column, verified: Column, denied: Column, button_labels: Column | None = None, button_uris: Column | None = None, known_address: Column | None = None) -> Column:
    """gift, sticker or other, by the first rule that holds."""
    none_ = F.array().cast("array<string>")
    labels, uris = (F.coalesce(c, none_) if c is not None else none_ for c in (button_labels, button_uris))
    names, values = (F.coalesce(c, none_) for c in (trait_names, trait_values))
    blob = F.lower(F.concat_ws(" ", name, collection, description))
    any_ = lambda xs, pattern: F.exists(xs, lambda x: F.lower(x).rlike(pattern))
    pack_trait, pack_number, pack_name = any_(names, "pack number|rarity|edition"), any_(names, "pack number"), blob.rlike(PACK)
    host = F.lower(F.coalesce(image, F.lit(""))).rlike(HOSTS)
    mint = (any_(labels, "mint") | any_(uris, "mint")) & (pack_trait | pack_name)
    gift = F.array_contains(names, "Model") & F.array_contains(names, "Backdrop") & F.array_contains(names, "Symbol")
    sticker = host | mint | any_(uris, "t\\.me/addstickers/") | any_(labels, "sticker pack|emoji") | blob.rlike(KNOWN_PACKS) | (F.coalesce(verified, F.lit(False)) & (pack_name | pack_trait)) | (pack_number & any_(values, RARITIES)) | (pack_name & pack_trait)
    if known_address is not None:
        sticker = sticker | F.coalesce(known_address, F.lit(False))
    drop = F.coalesce(denied, F.lit(False)) | (F.trim(blob) == "") | blob.rlike(SUSPICIOUS)
    return F.when(drop, "other").when(gift, "gift").when(sticker, "sticker").otherwise("other")


def asset_filter(spec: str) -> Column:
    """A predicate of all, listed, unlisted, or field:value; model, backdrop and symbol look into the traits."""
    if spec in ("listed", "unlisted"):
        return (F.col("status") == "Unlisted") == F.lit(spec == "unlisted")
    field, _, value = spec.partition(":")
    if field in ("model", "backdrop", "symbol") and value:
        return F.exists("traits", lambda t: (t["label"] == field.capitalize()) & (t["value"] == value))
    if field in ("collection", "format", "creator", "edition") and value:
        return F.col(field) == value
    return F.lit(True)


def asset_order(mode: str) -> list[Column]:
    """Order of one of nine modes, by default the highest floor first; the caller's ordinal breaks ties."""
    c = F.col
    modes = {"floor-asc": c("floor").asc(), "pnl-desc": c("pnl_pct").desc(), "daily-desc": c("daily_pct").desc(), "date-desc": c("acquired").desc(), "tag-asc": F.coalesce("tag", F.lit(0)).asc(), "model-rarity": F.coalesce("rarity", F.lit(99.0)).asc(), "mint-asc": F.coalesce(F.when(c("mint") != 0, c("mint")), F.lit(999_999)).asc(), "name-asc": F.collate("name", "UNICODE").asc()}
    return [modes.get(mode, c("floor").desc()), c("ord").asc()]


def token_order(native: str, mode: str = "value") -> list[Column]:
    c = F.col
    last = {"name": F.coalesce(c("name"), c("symbol")).asc(), "change": F.coalesce("change", F.lit(0.0)).desc()}.get(mode, c("value").desc())
    return [(c("symbol") != native).asc(), (~F.upper("symbol").isin(*STABLE)).asc(), (c("price") <= 0).asc(), last, c("ord").asc()]


def activity_search(rows: DataFrame, columns: list[str], query: str, direction: str | None = None) -> DataFrame:
    out = rows if direction in (None, "all") else rows.where(F.col("direction") == direction)
    return out.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))


def group_by_collection(assets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, value, cost and gain of each group; gain in percent of cost; unpriced ones counted."""
    priced = F.col("floor") > 0
    g = assets.groupBy(*keys).agg(F.count("*").alias("assets"), F.count_if(~priced).alias("unpriced"), F.sum(F.when(priced, F.col("floor")).otherwise(0.0)).alias("value"), F.sum("cost").alias("cost"))
    return g.withColumns({"quick_sale": F.col("value") * 0.95, "gain": F.col("value") - F.col("cost"), "gain_pct": F.when(F.col("cost") > 0, (F.col("value") - F.col("cost")) / F.col("cost") * 100).otherwise(0.0), "status": F.when(F.col("unpriced") > 0, "partial").otherwise("priced")})


def previews(assets: DataFrame, keys: list[str], item: str, n: int = 3) -> DataFrame:
    """The first ``n`` distinct items of each group in order, and how many more there are."""
    d = assets.select(*keys, item).distinct()
    w = Window.partitionBy(*keys).orderBy(item)
    first = d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("first_items"))
    return first.join(d.groupBy(*keys).agg((F.count("*") - n).alias("more")), keys).withColumn("more", F.greatest("more", F.lit(0)))


def allocation(assets: DataFrame, kind: str = "kind") -> DataFrame:
    """Value of each class and its share of all, in whole percent of at least 1."""
    by = assets.groupBy(kind).agg(F.sum("value").alias("value"))
    total = by.agg(F.greatest(F.sum("value"), F.lit(1.0)).alias("total"))
    return by.crossJoin(F.broadcast(total)).select(kind, "value", numbers.round_half_up(F.col("value") / F.col("total") * 100).alias("share"))


def performers(assets: DataFrame, keys: list[str]) -> DataFrame:
    """Best and worst gain and the sum of gains of each group; ties to the smaller id."""
    gain = F.col("floor") - F.col("cost")
    return assets.withColumn("gain", gain).groupBy(*keys).agg(F.min_by("asset_id", F.struct((-F.col("gain")).alias("g"), "asset_id")).alias("best"), F.min_by("asset_id", F.struct("gain", "asset_id")).alias("worst"), F.sum("gain").alias("gain"))


def day_gain(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Gain over a day from today's values and percent changes; changes of -99.9 % or less, or unknown, count as none."""
    change = F.col("change")
    before = F.when(change.isNull() | F.isnan(change) | (change <= -99.9), F.col("value")).otherwise(F.col("value") / (1 + change / 100))
    g = tokens.groupBy(*keys).agg(F.sum("value").alias("value"), F.sum(before).alias("before"))
    gain = F.col("value") - F.col("before")
    return g.select(*keys, gain.alias("gain"), F.when(F.col("before") > 0, gain / F.col("before") * 100).otherwise(0.0).alias("gain_pct"))


def top_share(balances: DataFrame, key: str, holder: str, n: int = 10) -> DataFrame:
    """Share of the ``n`` largest holders in each total."""
    w = Window.partitionBy(key).orderBy(F.col("balance").desc(), holder)
    top = balances.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).groupBy(key).agg(F.sum("balance").alias("top"))
    return top.join(balances.groupBy(key).agg(F.sum("balance").alias("total")), key).select(key, F.when(F.col("total") > 0, F.col("top") / F.col("total") * 100).otherwise(0.0).alias("top_pct"))


def union_preferring(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All of the first, and of the second what the first has not; one row per key."""
    return primary.unionByName(fallback.join(primary, keys, "left_anti")).dropDuplicates(keys)


def first_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), ordinal).alias("__r")).select("__r.*")


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), ordinal).alias("__r")).select("__r.*")


def candidates_merged(candidates: DataFrame, key: str = "collection") -> DataFrame:
    """Several sources' floors of a collection: the cheapest is the base, counters take the greatest."""
    return candidates.where("floor > 0").groupBy(key).agg(F.min_by(F.struct("floor", "source"), F.struct("floor", "source")).alias("x"), F.max("listed").alias("listed"), F.max("supply").alias("supply")).select(key, "x.*", "listed", "supply")


def brand(name: Column, rules: list[tuple[str, str]]) -> Column:
    """Brand of the first rule (brand, needle pattern) found in a name, else the name itself."""
    found = text.first_rule(F.lower(name), rules)
    return F.when(found != "", found).otherwise(name)


def unpivot_traits(rows: DataFrame, key: str, traits: list[str]) -> DataFrame:
    """Long rows (key, trait_type, value_key, value) of several trait columns; blanks are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("trait_type"), F.col(t).cast("string").alias("value")) for t in traits])).alias("t")
    return rows.select(key, pairs).select(key, "t.trait_type", text.key(F.col("t.value")).alias("value_key"), "t.value").where("value_key <> ''")
