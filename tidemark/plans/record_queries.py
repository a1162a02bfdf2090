"""The record normalisers as queries: payloads are made of the star-schema tables, the same records in SQL of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import records as C
from tidemark.plans.queries import SQL_KEY, as_of, query, r4
from tidemark.sources import tables as src


def _payload(**fields):
    """A JSON object as VARIANT; null fields are left out of it."""
    return F.parse_json(F.to_json(F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()]))).alias("payload")


def _odd(c: str, a, b=None):
    """``a`` in rows with an odd number, else ``b`` or nothing: so both of two shapes occur."""
    return F.when(F.col(c) % 2 == 1, a) if b is None else F.when(F.col(c) % 2 == 1, a).otherwise(b)


@query(f"""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN p_brand ELSE p_name END AS name, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice / 100 END AS native, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice END AS usd, p_size FROM part)
SELECT name, {SQL_KEY.format("name")} AS collection_key, native AS floor_native, usd AS floor_usd, round(CASE WHEN p_size % 7 = 0 THEN 3.5 WHEN native > 0 THEN usd / native ELSE 0 END, 4) AS usd_rate, CASE WHEN id % 2 = 1 THEN 'feed' ELSE 'xgift' END AS source, p_size::BIGINT AS listed FROM x WHERE native > 0 OR usd > 0""")
def floor_records(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    p = _payload(canonicalName=_odd("p_partkey", F.col("p_brand"), F.lit("")), floorTon=F.when(size % 5 != 0, price / 100), floorUsd=F.when(size % 3 != 0, price.cast("string")), tonUsdRate=F.when(size % 7 == 0, 3.5), marketPlatform=_odd("p_partkey", F.lit("feed")), listedCount=size)
    rows = src.table(spark, d, "part").select(F.col("p_name").alias("name"), p)
    return C.floor_records(rows).select("name", "collection_key", "floor_native", "floor_usd", r4(F.col("usd_rate"), "usd_rate"), "source", "listed")


@query(f"""WITH m AS (SELECT p_brand AS collection, p_type AS model, p_partkey AS listed, p_retailprice / 100 AS native, p_size FROM part)
SELECT collection, {SQL_KEY.format("collection")} AS collection_key, model, {SQL_KEY.format("model")} AS model_key, native AS floor_native, CASE WHEN p_size % 2 = 0 THEN native * 2 ELSE 0 END AS floor_usd, CASE WHEN p_size % 3 = 0 THEN 4.0 ELSE 3.0 END AS usd_rate, listed::BIGINT AS listed FROM m WHERE p_size % 5 > 0""")
def model_records(spark, d):
    size, native = F.col("p_size"), F.col("p_retailprice") / 100
    one = F.struct(F.concat(F.lit(" "), "p_type").alias("model"), F.when(size % 5 > 0, native).alias("floorTon"), F.when((size % 2 == 0) & (size % 5 > 0), (native * 2).cast("string")).alias("floorUsd"), F.when(size % 3 == 0, 4.0).alias("tonUsdRate"), F.col("p_partkey").alias("listedCount"))
    rows = src.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_list(one).alias("models")).select("name", _payload(tonUsdRate=F.lit(3.0), models=F.col("models")))
    return C.model_records(rows).select("collection", "collection_key", "model", "model_key", "floor_native", "floor_usd", "usd_rate", "listed")


@query(f"""WITH x AS (SELECT p_brand AS collection, unnest(['Model', 'Backdrop', 'Symbol']) AS trait_type, unnest([p_type, p_name, 'Pack ' || p_size]) AS value, p_partkey AS n, p_size FROM part)
SELECT collection, trait_type, value, {SQL_KEY.format("value")} AS value_key, round(CASE WHEN trait_type = 'Symbol' THEN p_size ELSE p_size / 10 END, 4)::DOUBLE AS rarity, n::BIGINT AS item_count, round(n / 1e3, 4) AS floor_native FROM x""")
def attribute_records(spark, d):
    n = F.col("p_partkey")
    of = lambda c, **more: F.collect_list(F.struct(F.col(c).alias("name"), *[v.alias(k) for k, v in more.items()]))
    stats = F.struct(n.alias("count"), (n * 1_000_000).alias("floor"))
    lists = src.table(spark, d, "part").withColumn("pack", F.concat(F.lit("Pack "), "p_size")).groupBy(F.col("p_brand").alias("name")).agg(of("p_type", rarity_per_mille=F.col("p_size"), stats=stats).alias("m"), of("p_name", rarity_per_mille=F.col("p_size"), total=n, floor=(n * 1_000_000).cast("string")).alias("b"), of("pack", rarity=F.col("p_size"), stats=stats).alias("s"))
    rows = lists.select("name", _payload(models=F.col("m"), backdrops=F.col("b"), patterns=F.col("s")))
    return C.attribute_records(rows).select("collection", "trait_type", "value", "value_key", r4(F.col("rarity"), "rarity"), "item_count", r4(F.col("floor_native"), "floor_native"))


@query("""SELECT p_brand AS collection, p_type AS model, round(p_partkey / 1e3, 4) AS floor_native, round(p_partkey / 1e3 * 3.12, 4) AS floor_usd, p_size::BIGINT AS listed, CASE WHEN p_size % 2 = 0 THEN 'video' ELSE 'image' END AS media FROM part WHERE p_size % 4 > 0 AND p_partkey > 0""")
def catalog_models(spark, d):
    size = F.col("p_size")
    one = F.struct(F.col("p_type").alias("name"), F.struct(F.when(size % 4 > 0, F.col("p_partkey") * 1_000_000).alias("floor"), size.alias("count")).alias("stats"), F.lit("https://a/b.png?x=1").alias("image_url"), F.when(size % 2 == 0, "https://a/b.MP4#t").alias("video_url"))
    rows = src.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_list(one).alias("models")).select("name", _payload(models=F.col("models")))
    return C.catalog_models(rows, 3.12).select("collection", "model", r4(F.col("floor_native"), "floor_native"), r4(F.col("floor_usd"), "floor_usd"), "listed", "media")


@query(f"""SELECT p_brand AS collection, p_type AS model, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS backdrop, {SQL_KEY.format("p_brand")} AS collection_key, {SQL_KEY.format("p_type")} AS model_key, CASE WHEN p_size % 2 = 0 THEN {SQL_KEY.format("p_name")} ELSE '' END AS backdrop_key FROM part WHERE p_size % 3 > 0""")
def requested_pairs(spark, d):
    size = F.col("p_size")
    pairs = src.table(spark, d, "part").select(F.concat(F.lit("  "), "p_brand").alias("collection"), F.when(size % 3 > 0, F.col("p_type")).otherwise(" ").alias("model"), F.when(size % 2 == 0, F.col("p_name")).alias("backdrop"), F.lit(None).cast("string").alias("symbol"))
    return C.requested_pairs(pairs).select("collection", "model", "backdrop", "collection_key", "model_key", "backdrop_key")


@query("""SELECT p_partkey AS asset_id, p_brand AS collection, p_type AS model, p_name AS backdrop, CASE WHEN p_size % 2 = 0 THEN 'Pack ' || p_size ELSE '' END AS symbol, p_size / 10 AS model_rarity, 0.5 AS backdrop_rarity FROM part WHERE p_size % 3 > 0""")
def holding_pairs(spark, d):
    size = F.col("p_size")
    trait = lambda label, value, shown: F.struct(F.lit(label).alias("trait_type"), value.alias("value"), shown.alias("rarity"))
    traits = F.array(trait("MODEL", F.col("p_type"), F.format_string("%.1f%%", size / 10)), trait("Backdrop", F.when(size % 3 > 0, F.col("p_name")), F.lit("0.5 %")), trait("symbol", F.when(size % 2 == 0, F.concat(F.lit("Pack "), size)), F.lit("")))
    rows = src.table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), _payload(collection=F.col("p_brand"), name=F.col("p_name"), attributes=traits))
    return C.holding_pairs(rows).select("asset_id", "collection", "model", "backdrop", "symbol", "model_rarity", "backdrop_rarity")


@query("""SELECT o_custkey AS wallet, 'A' || o_orderkey AS address, CASE WHEN o_orderkey % 2 = 1 THEN 'T' || o_orderkey ELSE 'JETTON' END AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 9 END AS decimals, round(floor(o_totalprice) * 1000 / CASE WHEN o_orderkey % 3 = 0 THEN 1e6 ELSE 1e9 END, 8) AS balance, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2.5 END AS price_usd FROM orders""")
def token_balances(spark, d):
    k = F.col("o_orderkey")
    one = F.struct(F.struct(F.concat(F.lit("A"), k).alias("address"), _odd("o_orderkey", F.concat(F.lit("T"), k)).alias("symbol"), F.when(k % 3 == 0, F.lit("6")).alias("decimals")).alias("jetton"), (F.floor("o_totalprice") * 1000).cast("string").alias("balance"), F.struct(F.struct(F.when(k % 5 > 0, 2.5).alias("USD")).alias("prices")).alias("price"))
    rows = src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("wallet")).agg(F.collect_list(one).alias("b")).select("wallet", _payload(balances=F.col("b")))
    return C.token_balances(rows).select("wallet", "address", "symbol", "decimals", F.round("balance", 8).alias("balance"), "price_usd")


@query("""SELECT o_custkey AS wallet, 'A' || o_orderkey AS address, CASE WHEN o_orderkey % 2 = 1 THEN 'M' || o_orderkey ELSE 'S' || o_orderkey END AS symbol, round(floor(o_totalprice) / CASE WHEN o_orderkey % 2 = 1 THEN 1e3 ELSE 1e9 END, 9) AS balance FROM orders WHERE o_orderkey % 7 > 0 AND floor(o_totalprice) > 0""")
def indexed_balances(spark, d):
    k = F.col("o_orderkey")
    one = F.struct(_odd("o_orderkey", F.struct(F.concat(F.lit("M"), k).alias("symbol"), F.lit(3).alias("decimals"))).alias("metadata"), F.concat(F.lit("S"), k).alias("symbol"), F.when(k % 7 > 0, F.concat(F.lit("A"), k)).alias("jetton"), F.floor("o_totalprice").cast("string").alias("balance"))
    rows = src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("wallet")).agg(F.collect_list(one).alias("b")).select("wallet", _payload(jetton_wallets=F.col("b")))
    return C.indexed_balances(rows).select("wallet", "address", "symbol", F.round("balance", 9).alias("balance"))


@query("""SELECT c_name AS address, CASE WHEN length(c_name) > 12 THEN left(c_name, 6) || '...' || right(c_name, 4) ELSE c_name END AS shown, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 0.5 END AS balance, CASE WHEN c_custkey % 2 = 1 THEN 'active' ELSE 'unknown' END AS status, c_custkey % 2 = 1 AS is_wallet FROM customer""")
def accounts(spark, d):
    k = F.col("c_custkey")
    rows = src.table(spark, d, "customer").select(F.col("c_name").alias("address"), _payload(balance=F.when(k % 3 > 0, (k * 500_000_000).cast("string")), status=_odd("c_custkey", F.lit("active")), interfaces=_odd("c_custkey", F.array(F.lit("x"), F.lit("wallet")))))
    return C.accounts(rows)


@query("""WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 1000000 / 1e9 WHEN p_partkey % 3 = 1 THEN p_size ELSE 0 END AS f, p_name, p_brand FROM part)
SELECT 'A' || k AS address, CASE WHEN k % 2 = 1 THEN p_name ELSE 'Collectible' END AS name, p_brand AS collection, round(f, 6)::DOUBLE AS floor_native, round(f * 3, 6)::DOUBLE AS floor_usd, k % 3 < 2 AS listed FROM x""")
def market_items(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = src.table(spark, d, "part").select(_payload(address=F.concat(F.lit("A"), k), metadata=F.struct(_odd("p_partkey", F.col("p_name")).alias("name")), collection=F.struct(F.col("p_brand").alias("name")), sale=F.when(k % 3 == 0, F.struct((k * 1_000_000).alias("price"))), listing=F.when(k % 3 == 1, F.struct(size.alias("price")))))
    return C.market_items(rows, 3.0).select("address", "name", "collection", F.round("floor_native", 6).alias("floor_native"), F.round("floor_usd", 6).alias("floor_usd"), "listed")


@query("""SELECT p_brand AS wallet, 'A' || p_partkey AS address, CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE p_type END AS name, p_type AS collection, CASE WHEN p_size % 4 = 0 THEN 'Goodies' WHEN p_size % 4 = 1 THEN 'Fuse' ELSE '' END AS source, p_partkey % 2 = 1 OR p_size % 4 = 0 AS verified FROM part""")
def wallet_items(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    meta = F.struct(_odd("p_partkey", F.col("p_name")).alias("name"), F.when(size % 4 == 0, "https://goodies-api-prod/x.png").alias("image"), F.when(size % 4 == 1, "of the Good Vibes Club").alias("description"))
    rows = src.table(spark, d, "part").select(F.col("p_brand").alias("wallet"), _payload(address=F.concat(F.lit("A"), k), metadata=meta, collection=F.struct(F.col("p_type").alias("name")), approved_by=_odd("p_partkey", F.array(F.lit("x"))), verified=size % 4 == 0))
    return C.wallet_items(rows).select("wallet", "address", "name", "collection", "source", "verified")


@query("""SELECT 'u' || l_suppkey AS buyer, round(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE l_quantity / 10 END, 4) AS price, round(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE l_quantity / 10 END * 3, 4) AS price_usd, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'see.tg' END AS market, l_orderkey::BIGINT AS mint FROM lineitem WHERE l_linenumber % 3 > 0""")
def feed_sales(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    p = _payload(price=F.when((n % 2 == 1) & (n % 3 > 0), F.struct(q.alias("ton"))), nanoton=F.when((n % 2 == 0) & (n % 3 > 0), (q * 1e8).cast("long")), owner=F.struct(F.concat(F.lit("u"), "l_suppkey").alias("name")), market=F.when(F.col("l_returnflag") == "R", "R"), num=F.col("l_orderkey"))
    return C.feed_sales(src.table(spark, d, "lineitem").select(p), 3.0).select("buyer", F.round("price", 4).alias("price"), F.round("price_usd", 4).alias("price_usd"), "market", "mint")


@query("""SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'id' || l_orderkey ELSE concat_ws('|', 'C' || l_suppkey, 'M' || l_partkey, 'B', l_returnflag, 's' || l_linenumber, l_shipdate::DATE, l_quantity::BIGINT) END AS sale_id, 'C' || l_suppkey AS collection, l_quantity AS price, l_shipdate::TIMESTAMP AS sold_at FROM lineitem WHERE l_linenumber % 3 > 0""")
def worker_sales(spark, d):
    n, day = F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd")
    p = _payload(id=F.when(n % 2 == 1, F.concat(F.lit("id"), "l_orderkey")), collection=F.concat(F.lit("C"), "l_suppkey"), modelName=F.concat(F.lit(" M"), "l_partkey"), backdrop=F.when(n % 3 != 0, "B"), market=F.col("l_returnflag"), slug=F.concat(F.lit("s"), n), normalizedPrice=F.col("l_quantity").cast("long"), soldAt=day)
    return C.worker_sales(src.table(spark, d, "lineitem").select(p)).select("sale_id", "collection", "price", "sold_at")


@query("""SELECT user_id AS token, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS at, value AS price FROM events WHERE value > 0""")
def chart_points(spark, d):
    """Three shapes by user: pairs in seconds, objects in seconds, objects in milliseconds."""
    u, at = F.col("user_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = src.table(spark, d, "events").select(u.alias("token"), at.alias("at"), "value")
    pairs = e.where(F.col("token") % 3 == 0).groupBy("token").agg(F.to_json(F.collect_list(F.array(F.col("at").cast("double"), F.col("value")))).alias("j"))
    objects = e.where(F.col("token") % 3 == 1).groupBy("token").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("at").alias("time"), F.col("value"))).alias("points"))).alias("j"))
    millis = e.where(F.col("token") % 3 == 2).groupBy("token").agg(F.to_json(F.struct(F.collect_list(F.struct((F.col("at") * 1000).alias("t"), F.col("value").alias("c"))).alias("chart"))).alias("j"))
    rows = pairs.unionByName(objects).unionByName(millis).select("token", F.parse_json("j").alias("payload"))
    return C.chart_points(rows)


@query("""WITH x AS (SELECT user_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS t, value AS v, user_id % 2 = 0 AS dollars FROM events)
SELECT user_id AS asset_id, t AS at, round(CASE WHEN dollars THEN v ELSE v * 2 END, 4) AS price_usd, CASE WHEN dollars THEN 0 ELSE v END AS price_native FROM x WHERE v > 0""")
def floor_points(spark, d):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    even = F.col("user_id") % 2 == 0
    point = F.struct(at.alias("timestamp"), F.when(even, F.col("value")).alias("usd"), F.when(~even, F.col("value")).alias("priceTon"))
    rows = src.table(spark, d, "events").groupBy(F.col("user_id").alias("asset_id")).agg(F.collect_list(point).alias("h"))
    rows = rows.select("asset_id", F.lit(5.0).alias("floor_native"), F.lit(10.0).alias("floor_usd"), _payload(floorHistory=F.col("h")))
    return C.floor_points(rows, as_of()).select("asset_id", "at", r4(F.col("price_usd"), "price_usd"), "price_native")


@query("""SELECT user_id AS wallet, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS at, value FROM events WHERE event_type <> 'error'""")
def wallet_points(spark, d):
    shown = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.struct(shown.alias("timestamp"), F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("valueUsd"))
    rows = src.table(spark, d, "events").groupBy(F.col("user_id").alias("wallet")).agg(F.collect_list(point).alias("h")).select("wallet", F.parse_json(F.to_json("h")).alias("payload"))
    return C.wallet_points(rows)


@query("""SELECT c_custkey AS wallet, '' AS address, 'TON' AS symbol, c_acctbal AS balance, 3.0 AS price_usd, round(c_acctbal * 3, 4) AS value_usd, true AS trusted FROM customer WHERE c_acctbal > 0
UNION ALL SELECT o_custkey, 'A' || o_orderkey, 'T' || o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN 2.0 ELSE 0.5 END, round(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice * 2 ELSE o_totalprice * 0.5 END, 4), o_orderkey % 3 = 0 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_totalprice > 0""")
def imported_tokens(spark, d):
    k, b = F.col("o_orderkey"), F.col("o_totalprice")
    one = F.struct(F.concat(F.lit("A"), k).alias("address"), F.concat(F.lit("T"), k).alias("symbol"), b.alias("balance"), _odd("o_orderkey", F.lit(2.0)).alias("priceUsd"), F.when(k % 2 == 0, b * 0.5).alias("valueUsd"), F.when(k % 3 == 0, "WhiteList").alias("verification"))
    held = src.table(spark, d, "orders").where("o_totalprice > 0").groupBy(F.col("o_custkey").alias("wallet")).agg(F.collect_list(one).alias("j"))
    rows = src.table(spark, d, "customer").select(F.col("c_custkey").alias("wallet"), "c_acctbal").join(held, "wallet", "left")
    rows = rows.select("wallet", _payload(assets=F.struct(F.struct(F.col("c_acctbal").alias("balance")).alias("ton"), F.col("j").alias("jettons"))))
    return C.imported_tokens(rows, 3.0).withColumn("value_usd", F.round("value_usd", 4))


@query("""WITH x AS (SELECT p_partkey AS item, p_retailprice AS usd, p_size FROM part WHERE p_size % 4 > 0)
SELECT item, usd AS floor_usd, round(CASE WHEN p_size % 2 = 1 THEN p_size ELSE usd / 0.19 END, 4) AS floor_native, round(CASE WHEN p_size % 3 = 0 THEN (usd - 500) / 500 * 100 ELSE 0 END, 4) AS change_24h FROM x WHERE usd <= 10000 AND CASE WHEN p_size % 2 = 1 THEN p_size ELSE usd / 0.19 END <= 5000""")
def item_prices(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    now = F.struct(F.struct(F.struct(F.when(size % 4 > 0, price).alias("usd"), F.when((size % 2 == 1) & (size % 4 > 0), size).alias("ton")).alias("floor")).alias("price"))
    day = F.struct(F.struct(F.struct(F.when(size % 3 == 0, 500).alias("usd")).alias("floor")).alias("price"))
    rows = src.table(spark, d, "part").select(F.col("p_partkey").alias("item"), _payload(current=now, **{"24h": day}))
    return C.item_prices(rows, 0.19).select("item", "floor_usd", r4(F.col("floor_native"), "floor_native"), r4(F.col("change_24h"), "change_24h"))


@query("""SELECT 'h' || o_orderkey AS hash, 's' || o_custkey AS sender, CASE WHEN o_orderkey % 2 = 1 THEN 'r' || o_custkey ELSE 'acc' END AS recipient, round(o_totalprice, 4) AS amount, 0.005 AS fee, o_orderdate::TIMESTAMP AS at, CASE WHEN o_orderkey % 5 = 0 THEN 'Failed' ELSE 'Success' END AS status FROM orders""")
def transactions(spark, d):
    k = F.col("o_orderkey")
    message = F.struct(F.concat(F.lit("s"), "o_custkey").alias("source"), _odd("o_orderkey", F.concat(F.lit("r"), "o_custkey")).alias("destination"), F.round(F.col("o_totalprice") * 1e9).cast("long").cast("string").alias("value"))
    p = _payload(hash=F.concat(F.lit("h"), k), account=F.lit("acc"), in_msg=message, total_fees=F.lit(5_000_000), now=F.unix_seconds(F.col("o_orderdate").cast("timestamp")), description=F.struct((k % 5 == 0).alias("aborted")))
    return C.transactions(src.table(spark, d, "orders").select(p)).withColumn("amount", F.round("amount", 4))
