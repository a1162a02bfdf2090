"""Names within names, without pairing all with all; catalogue items and collections found by loose names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.sources import plausible_floor


def _grams(c: Column, n: int) -> Column:
    """All substrings of n characters; none where the text is shorter."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))


def contained(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """Pairs (x, y) of distinct texts, neither empty, where x (of ``needles``) occurs in y (of ``hay``).

    Each needle is looked up by one of its substrings of three characters, that which the fewest texts have; shorter needles
    by the whole of themselves, which then is the answer.
    """
    having = hay.select("y", F.explode(F.array_distinct(F.concat(*[_grams(F.col("y"), n) for n in (1, 2, 3)]))).alias("g"))
    counts = having.groupBy("g").agg(F.count("*").alias("n"))
    own = F.when(F.length("x") >= 3, _grams(F.col("x"), 3)).otherwise(F.array("x"))
    looked = needles.select("x", F.explode(F.array_distinct(own)).alias("g")).join(counts, "g", "left")
    rarest = looked.groupBy("x").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("x", "m.g")
    return rarest.join(having, "g").where(F.contains("y", "x")).select("x", "y")


def either_within(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of texts, a of ``left`` and b of ``right``, one of which occurs in the other."""
    down = contained(right.select(F.col("b").alias("x")), left.select(F.col("a").alias("y"))).select(F.col("y").alias("a"), F.col("x").alias("b"))
    up = contained(left.select(F.col("a").alias("x")), right.select(F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return down.unionByName(up).distinct()


def tier_match(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each name's best catalogue row by tier: 1 equal key (also singular or plural), 2 equal alias, 3 alias within alias,
    4 key within key; ties to the earlier row. ``requests`` has name; ``catalog`` has ord and title.

    Tiers 1 and 2 are equi-joins. Only names they leave open go on to containment, on distinct texts; of catalogue rows with
    one text only the first counts.
    """
    n = requests.select("name").distinct().withColumns({"k": text.key(F.col("name")), "a": text.alias(F.col("name"))})
    c = catalog.select("ord", "title", text.key(F.col("title")).alias("ck"), text.alias(F.col("title")).alias("ca"))
    forms = F.array_distinct(F.filter(F.array("k", F.when(F.endswith("k", F.lit("s")), F.left("k", F.length("k") - 1)).otherwise(F.col("k")), F.concat("k", F.lit("s"))), lambda x: (x != "") & (x != "s")))
    one = n.select("name", F.explode(forms).alias("ck")).join(c, "ck").select("name", "ord", "title", F.lit(1).alias("tier"))
    two = n.where("a <> ''").join(c, F.col("a") == F.col("ca")).select("name", "ord", "title", F.lit(2).alias("tier"))
    best = lambda rows: rows.groupBy("name").agg(F.min_by(F.struct("ord", "title", "tier"), F.struct("tier", "ord")).alias("h"))
    exact = best(one.unionByName(two))
    left = n.join(exact, "name", "left_anti")

    def within(mine: str, theirs: str, tier: int) -> DataFrame:
        asked = left.where(F.col(mine) != "").select("name", F.col(mine).alias("a"))
        first = c.where(F.col(theirs) != "").groupBy(F.col(theirs).alias("b")).agg(F.min(F.struct("ord", "title")).alias("hit"))
        hits = either_within(asked.select("a").distinct(), first.select("b")).join(first, "b").groupBy("a").agg(F.min("hit").alias("hit"))
        return asked.join(hits, "a").select("name", "hit.*", F.lit(tier).alias("tier"))

    return exact.unionByName(best(within("a", "ca", 3).unionByName(within("k", "ck", 4)))).select("name", "h.*")


def clean_key(c: Column) -> Column:
    """Key of a name without its number, as in "Name #12"."""
    return text.key(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s+#\d+.*$", ""))


def _keys(requests: DataFrame, names: str, least: int) -> DataFrame:
    """Distinct (request, a): the keys of over ``least`` characters of a request's names."""
    return requests.select("request", F.explode(F.transform(F.col(names), clean_key)).alias("a")).where(F.length("a") > least).distinct()


def _loose(asked: DataFrame, named: DataFrame, id_col: str, least_asked: int, least_named: int) -> DataFrame:
    """Distinct (request, id): equal keys, or one within the other where both are long enough."""
    equal = asked.join(named.where("b <> ''"), F.col("a") == F.col("b")).select("request", id_col)
    left = asked.where(F.length("a") >= least_asked)
    right = named.where(F.length("b") >= least_named)
    pairs = either_within(left.select("a").distinct(), right.select("b").distinct())
    return equal.unionByName(left.join(pairs, "a").join(right, "b").select("request", id_col)).distinct()


def snapshot_match(requests: DataFrame, catalog: DataFrame, rate: float) -> DataFrame:
    """(request, ord, usd, native, source): the catalogue item that prices each request; none where there is no plausible one.

    ``requests`` has request and arrays of names: aliases, items (of the wanted item, perhaps empty) and collections.
    ``catalog`` has ord, collection, item, address, usd and native. First come items: by equal key of the wanted item, or
    where none is named, by an alias that is equal or of at least 8 characters with the item's of at least 6 within it or
    around it; or by equal address; the first in order with a plausible price counts. A request that names an item ends
    there. Others get the cheapest plausible item of the collections whose names are matched by the same rule. Nulls in the
    arrays or names match nothing; of repeated requests one comes back.
    """
    native = F.when(F.col("native") > 0, F.col("native")).otherwise(F.col("usd") / rate if rate > 0 else F.lit(0.0))
    priced = catalog.withColumn("native", native).where(plausible_floor(F.col("usd"), F.col("native")))
    wanted = _keys(requests, "items", 2)
    aliases = _keys(requests, "aliases", 2)
    specific = requests.where(F.exists("items", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")).select("request").distinct()
    named = catalog.select("ord", clean_key(F.col("item")).alias("b"))
    by_item = wanted.join(named, F.col("a") == F.col("b")).select("request", "ord")
    by_alias = _loose(aliases.join(wanted.select("request").distinct(), "request", "left_anti"), named, "ord", 8, 6)
    by_address = aliases.join(catalog.select("ord", clean_key(F.col("address")).alias("b")), F.col("a") == F.col("b")).select("request", "ord")
    hits = by_item.unionByName(by_alias).unionByName(by_address).join(priced, "ord")
    exact = hits.groupBy("request").agg(F.min(F.struct("ord", "usd", "native")).alias("h")).withColumn("source", F.lit("exact"))
    rest = _keys(requests, "collections", 2).join(specific, "request", "left_anti").join(exact, "request", "left_anti")
    low = priced.groupBy("collection").agg(F.min(F.struct("usd", "ord", "native")).alias("l"))
    collections = catalog.select("collection", clean_key(F.col("collection")).alias("b")).distinct()
    wide = _loose(rest, collections, "collection", 8, 6).join(low, "collection").groupBy("request").agg(F.min("l").alias("l"))
    cheap = wide.select("request", F.struct("l.ord", "l.usd", "l.native").alias("h"), F.lit("collection").alias("source"))
    return exact.unionByName(cheap).select("request", "h.*", "source")


def live_match(requests: DataFrame, catalog: DataFrame, fallback: bool = True) -> DataFrame:
    """(request, collection, item): the first item that an alias of over 3 characters equals, or contains or lies in where both
    have at least 8; else, with ``fallback``, the first collection by the same rule, with no item.

    ``requests`` has request and aliases; ``catalog`` has ord, collection and item; collections come in the order of their first item.
    """
    aliases = _keys(requests, "aliases", 3)
    items = _loose(aliases, catalog.select("ord", clean_key(F.col("item")).alias("b")), "ord", 8, 8)
    found = items.groupBy("request").agg(F.min("ord").alias("ord")).join(catalog, "ord").select("request", "collection", "item")
    if not fallback:
        return found
    first = catalog.groupBy("collection").agg(F.min("ord").alias("ord"))
    names = first.select("ord", clean_key(F.col("collection")).alias("b"))
    wide = _loose(aliases.join(found.select("request"), "request", "left_anti"), names, "ord", 8, 8)
    return found.unionByName(wide.groupBy("request").agg(F.min("ord").alias("ord")).join(first, "ord").select("request", "collection", F.lit(None).cast("string").alias("item")))
