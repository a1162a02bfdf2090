"""Catalogue reads, metadata joins, trust tests, and the work lists of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.records import number, string

#: Tags of assets that are trusted.
TRUSTED_TAGS = ("asset:essential", "asset:popular", "high_liquidity")


def collection_records(rows: DataFrame, rate: float) -> DataFrame:
    """(payload) of a catalogue's collections to name, key, floor and count; those without a name go. Floors come in billionths."""
    p = F.col("payload")
    native = number(p, "stats.floor") / 1e9
    r = rows.select(F.trim(string(p, "name", "collection", "title")).alias("name"), native.alias("floor_native"), (native * rate).alias("floor_usd"), number(p, "stats.count").cast("long").alias("listed"))
    return r.where("name <> ''").withColumn("collection_key", text.key(F.col("name")))


def bucket_of(rows: DataFrame, loose: bool = True) -> DataFrame:
    """(name, payload), an object of buckets by name, to (name, bucket_name, bucket): the one of equal key, or with ``loose``
    one whose key contains or lies in the name's; of several the first by name. No row without one."""
    entries = rows.select("name", "payload").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("payload").outer()))
    k, own = text.key(F.col("key")), text.key(F.col("name"))
    near = (k != "") & (own != "") & (F.contains(k, own) | F.contains(own, k)) if loose else F.lit(False)
    rank = F.when(k == own, 0).when(near, 1)
    return entries.withColumn("__t", rank).where("__t is not null and key is not null").groupBy("name").agg(F.min_by(F.struct(F.col("key").alias("bucket_name"), F.col("value").alias("bucket")), F.struct("__t", "key")).alias("b")).select("name", "b.*")


def market_scope(market: Column) -> Column:
    """Upper-case market; the aggregate is no market of its own."""
    m = F.upper(F.trim(F.coalesce(market, F.lit(""))))
    return F.when(m == "AGGREGATE", "").otherwise(m)


def anchored(shown: Column, trait: Column) -> Column:
    """Whether a shown trait is the wanted one, alone or with a remark in brackets after it; any is, where none is wanted."""
    t = F.trim(F.coalesce(trait, F.lit("")))
    return (t == "") | F.coalesce((shown == t) | F.startswith(shown, F.concat(t, F.lit(" ("))), F.lit(False))


def trusted_listed(blacklisted: Column, deprecated: Column, community: Column, default_symbol: Column, tags: Column) -> Column:
    """A listed asset that is neither barred nor community-made, and a default or tagged as essential, popular or liquid."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    tagged = F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, TRUSTED_TAGS))), F.lit(False))
    return no(blacklisted) & no(deprecated) & no(community) & (F.coalesce(default_symbol, F.lit(False)) | tagged)


def trusted_score(risk: Column) -> Column:
    return F.coalesce(risk, F.lit(1.0)) <= 0.6


def blocked_score(risk: Column) -> Column:
    return F.coalesce(risk, F.lit(0.0)) > 0.8


def usable_market(price: Column, liquidity: Column) -> Column:
    return F.coalesce((price > 0) & (liquidity > 0), F.lit(False))


def exceeds_cap(value: Column, cap: Column) -> Column:
    """A holding worth more than the whole market can't be right."""
    return F.coalesce((cap > 0) & (value > cap * 1.05), F.lit(False))


def resolve_ids(tokens: DataFrame, known: DataFrame, listed: DataFrame) -> DataFrame:
    """``tokens`` (address) with id: from ``known`` (address, id), else of the first of ``listed`` (ord, address, id), else null.

    Addresses compare without case and outer blanks; a blank one has no id.
    """
    k = lambda d: F.nullif(F.lower(F.trim(d["address"])), F.lit(""))
    sure = known.select(k(known).alias("__k"), F.col("id").alias("__sure")).dropDuplicates(["__k"])
    first = listed.select(k(listed).alias("__k"), "ord", "id").groupBy("__k").agg(F.min_by("id", "ord").alias("__listed"))
    j = tokens.withColumn("__k", k(tokens)).join(sure, "__k", "left").join(first, "__k", "left")
    return j.withColumn("id", F.coalesce("__sure", "__listed")).drop("__k", "__sure", "__listed")


def recent(rows: DataFrame, key: str, limit: int | None, most: int = 1000) -> DataFrame:
    """The newest rows (at, event_id) of each key; as many as asked for, 1 to ``most``. The limit is the feature."""
    n = max(1, min(most, limit or most))
    newest = Window.partitionBy(key).orderBy(F.col("at").desc(), F.col("event_id").desc())
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def override(rows: DataFrame, more: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``more`` (one row per key) where it has them, neither null nor empty."""
    m = more.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    j = rows.join(m, keys, "left")
    for c in columns:
        there = F.col(f"__{c}").isNotNull() & (F.col(f"__{c}").cast("string") != "")
        j = j.withColumn(c, F.when(there, F.col(f"__{c}")).otherwise(F.col(c)))
    return j.drop(*[f"__{c}" for c in columns])


def visible_totals(tokens: DataFrame, key: str = "wallet") -> DataFrame:
    """Value and number of each wallet's shown tokens, of which other than native, and whether any still loads its price."""
    value = F.coalesce("value", F.lit(0.0))
    native = F.sum(F.when(F.col("native"), value).otherwise(0.0))
    return tokens.groupBy(key).agg(F.sum(value).alias("total"), F.greatest(F.sum(value) - native, F.lit(0.0)).alias("other"), F.count("*").alias("tokens"), F.coalesce(F.bool_or("loading"), F.lit(False)).alias("pending"))


def pages_left(targets: DataFrame, done: DataFrame, scanner: str) -> DataFrame:
    """(collection, page) still to scan: ``targets`` has collection and pages, ``done`` collection, scanner and page.

    Pages that another version of the scanner read don't count.
    """
    every = targets.where("pages > 0").select("collection", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages").cast("long") - 1)).alias("page"))
    return every.join(done.where(F.col("scanner") == scanner).select("collection", F.col("page").cast("long").alias("page")).distinct(), ["collection", "page"], "left_anti")


def slices_left(slices: DataFrame, done: DataFrame, scanner: str) -> DataFrame:
    """(collection, backdrop) still to scan, a predicate each."""
    return slices.select("collection", "backdrop").distinct().join(done.where(F.col("scanner") == scanner), ["collection", "backdrop"], "left_anti")


def publishable(targets: DataFrame, done: DataFrame, scanner: str) -> DataFrame:
    """Collections all of whose pages this version has scanned; partial results are withheld."""
    return targets.where("pages > 0").select("collection").distinct().join(pages_left(targets, done, scanner).select("collection").distinct(), "collection", "left_anti")
