"""Catalogue reads, metadata joins, trust tests, work lists and routes as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as K
from tidemark.operators import registry as R
from tidemark.plans import routes
from tidemark.plans.queries import _LAST, COMBO, FLOORS, HOLDINGS, LEDGER, LISTINGS, SQL_KEY, query, r4, sale_as_of
from tidemark.plans.record_queries import _payload
from tidemark.sources import tables as src


@query(f"""SELECT p_name AS name, {SQL_KEY.format("p_name")} AS collection_key, round(p_partkey / 1e3, 4) AS floor_native, round(p_partkey / 1e3 * 3, 4) AS floor_usd, p_size::BIGINT AS listed FROM part WHERE p_size % 4 > 0""")
def collection_records(spark, d):
    size, name = F.col("p_size"), F.col("p_name")
    stats = F.struct((F.col("p_partkey") * 1_000_000).cast("string").alias("floor"), size.alias("count"))
    p = _payload(name=F.when(size % 4 == 1, name), collection=F.when(size % 4 == 2, name), title=F.when(size % 4 == 3, name), stats=stats)
    return K.collection_records(src.table(spark, d, "part").select(p), 3.0).select("name", "collection_key", r4(F.col("floor_native"), "floor_native"), r4(F.col("floor_usd"), "floor_usd"), "listed")


@query(f"""WITH b AS (SELECT DISTINCT upper(p_name) AS bucket_name FROM part), n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part UNION SELECT DISTINCT p_name FROM part),
x AS (SELECT name, bucket_name, {SQL_KEY.format("bucket_name")} AS k, {SQL_KEY.format("name")} AS own FROM n, b)
SELECT name, arg_min(bucket_name, row(CASE WHEN k = own THEN 0 ELSE 1 END, bucket_name)) AS bucket_name FROM x WHERE k = own OR contains(k, own) OR contains(own, k) GROUP BY 1""")
def bucket_pick(spark, d):
    """Each name comes with the whole payload, as a response does: an object of a few dozen buckets."""
    part = src.table(spark, d, "part")
    names = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).union(part.select("p_name")).distinct()
    payload = part.select(F.upper("p_name").alias("k")).distinct().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", F.lit(1))))).alias("j"))
    return K.bucket_of(names.crossJoin(F.broadcast(payload)).select("name", F.parse_json("j").alias("payload"))).select("name", "bucket_name")  # one payload


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN upper(l_linestatus) = 'O' THEN '' ELSE 'F' END AS scope, l_quantity % 3 <> 1 AS fits FROM lineitem")
def trait_anchored(spark, d):
    q = F.col("l_quantity").cast("int") % 3
    shown = F.when(q == 0, "Red.").when(q == 1, "Red.dish").otherwise("Red. (2%)")
    return src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), K.market_scope(F.when(F.col("l_linestatus") == "O", " aggregate").otherwise("f ")).alias("scope"), K.anchored(shown, F.lit(" Red. ")).alias("fits"))


@query("""SELECT s_suppkey AS id, s_suppkey % 5 <> 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AS listed_ok, coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 10 / 10 END, 1) <= 0.6 AS score_ok, coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 10 / 10 END, 0) > 0.8 AS barred, s_acctbal > 0 AS usable, s_suppkey > 0 AND s_acctbal > s_suppkey * 100 * 1.05 AS over_cap FROM supplier""")
def market_trust(spark, d):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    risk = F.when(k % 4 > 0, k % 10 / 10)
    tags = F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("asset:popular")))
    return src.table(spark, d, "supplier").select(k.alias("id"), K.trusted_listed(k % 5 == 0, F.lit(None).cast("boolean"), F.lit(False), F.when(k % 2 == 0, True), tags).alias("listed_ok"), K.trusted_score(risk).alias("score_ok"), K.blocked_score(risk).alias("barred"), K.usable_market(b, F.lit(1.0)).alias("usable"), K.exceeds_cap(b, k * 100).alias("over_cap"))


@query("""SELECT p_partkey AS token, CASE WHEN p_size % 3 = 0 THEN 'known' || p_size WHEN p_size % 3 = 1 THEN (SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE s_nationkey = p_size % 25) END AS id FROM part""")
def resolve_ids(spark, d):
    size = F.col("p_size")
    part = src.table(spark, d, "part")
    tokens = part.select(F.col("p_partkey").alias("token"), F.when(size % 3 == 0, F.concat(F.lit(" K"), size)).when(size % 3 == 1, F.concat(F.lit("n"), size % 25)).otherwise(" ").alias("address"))
    known = part.select(F.concat(F.lit("k"), size).alias("address"), F.concat(F.lit("known"), size).alias("id")).distinct()
    listed = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("N"), "s_nationkey").alias("address"), F.col("s_name").alias("id"))
    return K.resolve_ids(tokens, known, listed).select("token", "id")


@query(f"""WITH {LEDGER} SELECT wallet, event_id, row_number() OVER (PARTITION BY wallet ORDER BY at DESC, event_id DESC)::INT AS rank FROM ledger QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY at DESC, event_id DESC) <= 1000""")
def recent_activity(spark, d):
    """The read's limit of 1,000 rows a wallet is the feature."""
    return K.recent(src.ledger(spark, d), "wallet", 5000).select("wallet", "event_id", "rank")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN 'icon' || p_partkey ELSE 'none' END AS icon FROM part""")
def metadata_override(spark, d):
    part, size = src.table(spark, d, "part"), F.col("p_size")
    more = part.select(F.col("p_partkey").alias("id"), F.when(size % 2 == 0, F.col("p_type")).otherwise("").alias("name"), F.when(size % 2 == 0, F.concat(F.lit("icon"), "p_partkey")).alias("icon"))
    return K.override(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("none").alias("icon")), more, ["id"], ["name", "icon"])


@query("""SELECT o_custkey AS wallet, round(sum(o_totalprice), 2) AS total, round(greatest(sum(o_totalprice) - sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE 0 END), 0), 2) AS other, count(*) AS tokens, bool_or(o_orderkey % 11 = 0) AS pending FROM orders GROUP BY 1""")
def visible_totals(spark, d):
    k = F.col("o_orderkey")
    t = src.table(spark, d, "orders").select(F.col("o_custkey").alias("wallet"), F.col("o_totalprice").alias("value"), (k % 5 == 0).alias("native"), (k % 11 == 0).alias("loading"))
    return K.visible_totals(t).select("wallet", F.round("total", 2).alias("total"), F.round("other", 2).alias("other"), "tokens", "pending")


def _scan(spark, d):
    """Orders as collections of five pages; line items as pages done, by two versions of a scanner."""
    targets = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("collection"), F.lit(5).alias("pages"))
    done = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("collection"), (F.col("l_linenumber") - 1).alias("page"), F.col("l_linestatus").alias("scanner"))
    return targets, done


@query("""WITH w AS (SELECT o_orderkey AS collection, unnest(range(5)) AS page FROM orders) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = collection AND l_linenumber - 1 = page AND l_linestatus = 'F')""")
def pages_left(spark, d):
    return K.pages_left(*_scan(spark, d), "F")


@query("""SELECT o_orderkey AS collection FROM orders WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_linenumber BETWEEN 1 AND 5) = 5""")
def publishable(spark, d):
    return K.publishable(*_scan(spark, d), "F")


@query(f"""WITH {LISTINGS} SELECT DISTINCT collection, backdrop FROM listings l WHERE NOT EXISTS (SELECT 1 FROM listings x WHERE x.collection = l.collection AND x.backdrop = l.backdrop AND month(x.sold_at) = 1)""")
def slices_left(spark, d):
    l = src.listings(spark, d)
    return K.slices_left(l, l.select("collection", "backdrop", F.date_format("sold_at", "MM").alias("scanner")).distinct(), "01")


@query(f"""WITH {FLOORS}, {HOLDINGS} SELECT h.collection, h.model, h.backdrop, f.floor, f.listed, CASE WHEN f.floor IS NULL THEN 'pending' WHEN f.listed <= 1 THEN 'thin' ELSE 'priced' END AS status
FROM (SELECT DISTINCT collection, model, backdrop FROM holdings) h LEFT JOIN floors f ON f.collection = h.collection AND f.model = h.model AND f.backdrop = h.backdrop""")
def route_bulk_floors(spark, d):
    return routes.bulk_floors(src.holdings(spark, d), src.listings(spark, d)).select(*COMBO, "floor", "listed", "status")


@query(f"""WITH {FLOORS}, sales AS (SELECT collection, model, backdrop, market, sale_price AS price, sold_at, listing_id AS sale_id FROM listings), {_LAST}
SELECT collection, model, backdrop, floor, listed, round(last_price, 4) AS last_price FROM floors JOIN last USING (collection, model, backdrop) WHERE listed > 1""")
def route_asset_detail(spark, d):
    l = src.listings(spark, d)
    pairs = R.combo_floor(l).where("listed > 1").select(*COMBO)
    return routes.asset_detail(pairs, l, src.sales(spark, d), sale_as_of()).select(*COMBO, "floor", "listed", r4(F.col("last_price"), "last_price"))
