"""Operators on hand-written rows, each against a plain model."""

import datetime as dt
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addresses, numbers, payload, text
from tidemark.operators import details as D
from tidemark.operators import holdings as H
from tidemark.operators import registry as R
from tidemark.operators import series as T
from tidemark.operators import snapshots as N
from tidemark.operators import valuation as V
from tidemark.plans import routes
from tidemark.sources.store import Store
from tidemark.streaming.fold import fold_stream
from tidemark.streaming.sales import daily_floors, new_sales

T0 = dt.datetime(2024, 1, 1)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# Names


@pytest.mark.parametrize("word,want", [("boxes", "box"), ("berries", "berry"), ("watches", "watch"), ("glass", "glass"), ("cats", "cat"), ("bus", "bus"), ("classes", "classe"), ("hat", "hat")])
def test_singular(spark, word, want):
    assert one(spark, text.singular(F.lit(word)))[0] == want


def test_keys_and_aliases(spark):
    n = F.lit("Toy Bears & Boxes (rare)")
    got = one(spark, text.key(n), text.slug(n), text.trait_clean(n), text.identity(n), text.alias_keys(n), text.unicode_key(F.lit("Ünï 1")))
    assert got[0] == "toybearsboxesrare" and got[1] == "toy-bears-boxes-rare" and got[2] == "toybearandboxe" and got[3] == "toybearboxrare" and got[5] == "ünï1"
    assert got[4][:4] == ["toybearsboxesrare", "toybearboxesrare", "toybearsboxerare", "toybearsboxrare"] and got[4][-1] == "toybearboxrare"
    assert set(one(spark, text.registry_alias_keys(F.lit("red boxes")))[0]) == {"redboxes", "redsboxes", "redbox", "redsbox"}
    assert set(one(spark, text.signature_keys(F.lit("big watches")))[0]) == {"bigwatches", "bigwatch", "bigwatche"}
    assert one(spark, text.registry_alias_keys(F.lit("")), text.alias_keys(F.lit(None).cast("string")))[:] == ([], [])
    assert one(spark, text.family(F.lit("Onyx Black")), text.family(F.lit("Ivory White")), text.family(F.lit("plain")))[:] == ("dark", "light", "")
    assert one(spark, text.alias_matches(F.array(F.lit("Toy Bears")), F.lit("toy bear")), text.alias_includes(F.array(F.lit("Toy Bears")), F.lit("bear")))[:] == (True, True)


def test_numbers(spark):
    assert one(spark, numbers.number(F.lit("x")), numbers.number(F.lit(" 2.5 ")), numbers.percent(F.lit("−1.5%")))[:] == (0.0, 2.5, -1.5)
    assert one(spark, numbers.scaled(F.lit("123456789012345678901"), F.lit(9)))[0] == pytest.approx(123456789012.34568, rel=1e-15)
    assert one(spark, numbers.round_half_up(F.lit(-0.5)), numbers.clamp(F.lit(float("nan")), 1, 2), numbers.market_premium(F.lit("Black")), numbers.market_premium(F.lit("void sky")))[:] == (0, 1.0, 7.06, 1.25)
    for n in range(1, 13):
        values = [float(i * i) for i in range(n, 0, -1)]
        for p in (0.0, 0.25, 0.35, 0.5, 0.9, 1.0):
            assert one(spark, numbers.floor_rank(F.array(*map(F.lit, values)), p))[0] == sorted(values)[int(math.floor((n - 1) * p))]
    h = 2166136261
    for c in b"noiretrose:ivorywhite":
        h = (h ^ c) * 16777619 % (1 << 32)
    assert one(spark, numbers.fnv1a(F.lit("noiretrose:ivorywhite")))[0] == h


def test_addresses(spark):
    raw = "0:" + "ab" * 32
    friendly = addresses.friendly_form(raw)
    assert addresses.raw_form(friendly) == raw and addresses.raw_form(friendly[:-2] + "AA") is None and addresses.parse("") is None
    df = spark.createDataFrame([(raw,), (friendly,), ("Plain",), (None,), (" ",)], "a string")
    assert [r[0] for r in df.select(addresses.canonical(F.col("a"))).collect()] == [raw, raw, "plain", None, None]
    assert friendly in df.select(addresses.variants(F.col("a"))).first()[0]


def test_payload_walk(spark):
    df = spark.sql("""select 1 as id, parse_json('{"a": {"b": [ {"c": 1}, {"c": 2} ]}, "d": 3}') as p""")
    levels = [r.level for r in payload.walk(df, "p", 4).collect()]
    assert sorted(levels) == [0, 1, 2, 3, 3]


# Snapshots


def plain_fold(samples, beat=23 * 3600, soon=20 * 60):
    out = []
    for t, v in samples:
        if out and (t - out[-1][0]).total_seconds() < beat and abs(out[-1][1] - v) <= 1e-6:
            continue
        if out and (t - out[-1][0]).total_seconds() < soon:
            out[-1] = (t, v)
        else:
            out.append((t, v))
    return out


def sample_rows(seed, n=300):
    rng, at, rows = random.Random(seed), T0, []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([3, 10, 19, 20, 21, 300, 1379, 1380, 1500]))
        rows.append((f"k{i % 3}", at, float(rng.choice([1, 1, 1, 2])), i))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fold(spark, seed):
    rows, want = sample_rows(seed), defaultdict(list)
    got = N.fold(spark.createDataFrame(rows, "k string, sampled_at timestamp, floor double, event_id long"), ["k"])
    for k in ("k0", "k1", "k2"):
        want[k] = plain_fold([(t, v) for x, t, v, _ in rows if x == k])
        assert sorted((r.sampled_at, r.floor) for r in got.where(F.col("k") == k).collect()) == want[k]


def test_fold_over_slices_of_time(spark):
    rng = random.Random(8)  # long runs of equal values, many changes within minutes, gaps of days
    t, rows = T0, []
    for i in range(600):
        t += dt.timedelta(minutes=rng.choice([1, 7, 19, 20, 200, 1379, 1380, 4000]))
        rows.append(("k", t, float(rng.choice([1, 1, 1, 2])), i))
    df = spark.createDataFrame(rows, "k string, sampled_at timestamp, floor double, event_id long")
    for hours in (1, 24, 1000):
        got = [(r.sampled_at, r.floor) for r in N.fold(df, ["k"], slice_hours=hours).collect()]
        assert sorted(got) == plain_fold([(t, v) for _, t, v, _ in rows])
    soon = dt.timedelta(minutes=N.OVERWRITE_MINUTES)
    stay = [r[1] for r, s in zip(rows, [*rows[1:], None], strict=True) if s is None or s[1] - r[1] >= soon]
    assert sorted(r.sampled_at for r in N.fold(df, ["k"], suppress=False).collect()) == stay


def test_fold_stream_agrees_with_batch(spark, tmp_path):
    rows = sample_rows(3, 120)
    schema = "k string, sampled_at timestamp, floor double, event_id long"
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("k", "sampled_at", "floor")
    q = fold_stream(stream, ["k"]).writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.sql("select k, seq, max_by(struct(sampled_at, floor), sampled_at) x from folded group by k, seq")
    for k in ("k0", "k1", "k2"):
        assert sorted((r.x.sampled_at, r.x.floor) for r in got.where(F.col("k") == k).collect()) == plain_fold([(t, v) for x, t, v, _ in rows if x == k])


def test_sales_streams(spark, tmp_path):
    rows = [("a", f"s{i % 5}", T0 + dt.timedelta(hours=i % 5), 10.0 - i % 5) for i in range(10)] + [("a", "late", T0 + dt.timedelta(days=9), 1.0)]
    spark.createDataFrame(rows, "collection string, sale_id string, sold_at timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("collection string, sale_id string, sold_at timestamp, price double").parquet(f"{tmp_path}/in")
    for name, df in (("fresh", new_sales(stream)), ("days", daily_floors(stream))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(180)
    assert spark.table("fresh").count() == 6
    assert [(r.day, r.low, r.sold) for r in spark.table("days").collect()] == [(T0.date(), 6.0, 5)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "collection_key string, model_key string, backdrop_key string, sampled_at timestamp, floor_native double"
    for i, (hours, floor) in enumerate([(0, 1.0), (1, 1.0), (1.1, 2.0), (24, 2.0), (25, 2.0), (60, 2.0)]):
        store.append_snapshots(spark.createDataFrame([("c", "m", "b", T0 + dt.timedelta(hours=hours), floor), (f"d{i}", "m", "b", T0, 5.0)], schema))
    from tidemark.sources import tables

    kept = store.read("snapshots", tables.SNAPSHOTS).where("collection_key = 'c'").orderBy("sampled_at").collect()
    assert [((r.sampled_at - T0).total_seconds() / 3600, float(r.floor_native)) for r in kept] == [(0, 1.0), (1.1, 2.0), (25, 2.0), (60, 2.0)]
    assert store.read("snapshots", tables.SNAPSHOTS).count() == 10
    listings = spark.createDataFrame([("C", "M", "B", "x", 3.0, "1"), ("C", "M", "B", "x", 2.0, "2"), ("C", "N", "B", "x", 9.0, "3"), ("C", "N", "B", "x", 9.0, "3"), ("C", "N", "", "x", 1.0, "4")], "collection string, model string, backdrop string, market string, price double, listing_id string")
    floors = R.combo_floor(listings)
    at = lambda h: F.lit(T0 + dt.timedelta(hours=h))
    for h in (0, 1, 30):
        store.ingest_buckets(floors, at(h))
    got = store.lookup(listings).collect()
    assert sorted((r.combo, r.floor, r.listed) for r in got) == [("m:b", 2.0, 2), ("n:b", 9.0, 1)]
    assert spark.read.parquet(f"{tmp_path}/history").count() == 4


# Series and tokens


def test_nearest_prefers_the_earlier_of_equal_gaps(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    quotes = spark.createDataFrame([(1, at(0), 5.0), (1, at(2), 7.0), (1, at(9), 0.0)], "wallet long, at timestamp, price double")
    probes = spark.createDataFrame([(1, at(1), 1), (1, at(1.5), 2), (1, at(9), 3), (2, at(1), 4)], "wallet long, at timestamp, n int")
    got = {r.n: r.price for r in T.nearest_price(probes, quotes, fallback=F.lit(-1.0)).collect()}
    assert got == {1: 5.0, 2: 7.0, 3: -1.0, 4: -1.0}


def test_balances_of_emptied_wallets(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    moves = spark.createDataFrame([(1, at(0), 5.0), (1, at(5), -5.0), (2, at(0), 4.0), (2, at(6), 3.0), (3, at(1), -9.0)], "wallet long, at timestamp, amount double")
    probes = spark.createDataFrame([(w, at(h)) for w in (1, 2, 3) for h in (-1, 0, 5, 7)], "wallet long, at timestamp")
    got = {(r.wallet, int((r.at - T0).total_seconds() // 3600)): r.balance for r in T.balances(probes, moves).collect()}
    assert [got[1, h] for h in (-1, 0, 5, 7)] == [0, 5, 0, 0] and [got[2, h] for h in (-1, 0, 5, 7)] == [0, 4, 4, 7]


def test_series_go_on_over_slices_of_time(spark):
    rng = random.Random(4)
    at = lambda h: T0 + dt.timedelta(hours=h)
    wallets = [1] * 8 + [2, None]  # most rows belong to one
    quotes = [(rng.choice(wallets), at(t), float(rng.randint(1, 99))) for t in rng.sample(range(2400), 150)]
    moves = [(rng.choice(wallets), at(rng.randrange(2400)), float(rng.randint(-5, 9))) for _ in range(300)]
    probes = [(rng.choice(wallets), at(rng.randrange(-50, 2500)), n) for n in range(200)]
    q, m = (spark.createDataFrame(rows, f"wallet long, at timestamp, {c} double") for rows, c in ((quotes, "price"), (moves, "amount")))
    p = spark.createDataFrame(probes, "wallet long, at timestamp, n int")
    price = {r.n: r.price for r in T.nearest_price(p, q, slice_hours=7).collect()}
    line = {r.n: r.price for r in T.interpolated(p, q, slice_hours=7).collect()}
    held = {r.n: r.balance for r in T.balances(p, m, slice_hours=7).collect()}
    for w, t, n in probes:
        own = sorted((x[1], x[2]) for x in quotes if x[0] == w)
        assert price[n] == (min(own, key=lambda x: (abs(x[0] - t), x[0]))[1] if own else None)
        a, b = [x for x in own if x[0] <= t][-1:], [x for x in own if x[0] > t][:1]
        want = a[0][1] + (b[0][1] - a[0][1]) * ((t - a[0][0]) / (b[0][0] - a[0][0])) if a and b else (a or b)[0][1]
        assert math.isclose(line[n], want)
        if w is not None:  # movements of no wallet belong to no wallet
            mine = [x for x in moves if x[0] == w]
            now, run = max(0.0, sum(x[2] for x in mine)), sum(x[2] for x in mine if x[1] <= t)
            later = sum(x[2] for x in mine if x[1] > t)
            assert held[n] == max(0.0, run if now == 0 and any(x[2] > 0 for x in mine) else now - later)
    points = [(w, at(h), n, rng.choice([None, *range(50)])) for n, (w, h) in enumerate((rng.choice(wallets), rng.randrange(900)) for _ in range(200))]
    df = spark.createDataFrame(points, "wallet long, at timestamp, n int, value long").withColumn("value", F.col("value").cast("double"))
    got = {r.n: r.change_pct for r in T.changes(df, ["wallet"], ordinal="n", slice_hours=5).collect()}
    assert len(got) == len(points)
    for w in (1, 2, None):
        before = None
        for _, _, n, v in sorted((x for x in points if x[0] == w), key=lambda x: (x[1], x[2])):
            assert math.isclose(got[n], 0.0 if before is None or v is None else (v - before) / max(1, before) * 100)
            before = v
    pinned = {r.n: r.value for r in T.pin_last(df.where("wallet = 1"), ["wallet"], F.lit(-1.0)).collect()}
    ends = max(x[1] for x in points if x[0] == 1)
    assert [x[1] for x in points if pinned.get(x[2]) == -1.0] == [ends]


def test_floor_from_sales_merges_close_points(spark):
    now = T0 + dt.timedelta(days=3)
    sale = lambda key, ms_before, price: (key, now - dt.timedelta(milliseconds=ms_before), price)
    sales = spark.createDataFrame([sale("a", 500, 4.0), sale("a", 86_400_000, 9.0), sale("a", 86_400_001, 8.0), sale("b", 5000, 3.0), sale("c", 400, 2.0), sale("d", 9 * 86_400_000, 1.0)], "k string, sold_at timestamp, price double")
    floors = spark.createDataFrame([("a", 6.0), ("b", 0.0), ("c", 7.0), ("d", 5.0)], "k string, floor double")
    got = sorted((r.k, r.at, r.price) for r in D.floor_from_sales(sales, floors, ["k"], F.lit(now)).collect())
    # The sale half a second ago, its day's cheapest, keeps its time and takes the floor's price; series of one point go.
    assert got == [("a", now - dt.timedelta(milliseconds=86_400_001), 8.0), ("a", now - dt.timedelta(milliseconds=500), 6.0)]


def test_mentions_of_tokens(spark):
    cases = [("got 5 Ton", "", "", "TON", "x", True), ("Tonic", "", "", "TON", "Tonic", False), ("a.b*!", "", "", "b*", "", True), ("abc", "", "", "b", "", False), ("my Big Coin", "", "", "", "big coin", True), ("big", "", "", "", "big", False), ("", '["EQx"]', "eqX", "", "", True), (None, None, None, None, None, False)]
    df = spark.createDataFrame(cases, "said string, adr string, address string, symbol string, name string, want boolean")
    assert [r.got for r in df.select("*", D.mentions_token(*(F.col(c) for c in df.columns[:5])).alias("got")).collect()] == [c[-1] for c in cases]


def test_quality_rules(spark):
    rows = [("blacklist", "A", "A", 1.0, 0.0, True, 1e6, 1e6, 99), ("none", "Unknown Jetton", "A", 1.0, 0.0, True, 1e6, 1e6, 99), ("none", "A", "A", 500.0, 0.0, False, 0.0, 0.0, 0), ("none", "A", "A", 500.0, None, True, 60.0, 1.0, 1), ("none", "A", "A", 60000.0, 5.0, True, 100.0, 1e6, 99), ("whitelist", "A", "A", 60000.0, 5.0, True, 0.0, 0.0, 0), ("none", "A", "A", 50.0, 0.0, True, 60.0, 1.0, 1), ("none", "A", "A", 50.0, 0.0, False, 0.0, 0.0, 0)]
    df = spark.createDataFrame([(i, *r, 1.0) for i, r in enumerate(rows)], "id int, verification string, name string, symbol string, value double, change double, market_backed boolean, liquidity double, volume double, trades int, price double")
    got = [(r.quality_reason, r.value) for r in H.gate(df).orderBy("id").collect()]
    assert [g[0] for g in got] == ["blacklisted", "generic-metadata", "unconfirmed-tonapi-price", "stale-dex-price", "weak-dex-market", "verified", "unverified-but-market-backed", "unpriced"]
    assert [g[1] for g in got[:5]] == [0.0] * 5


# Valuation


def bridge(a, b, low, high):
    return min(high, max(low, math.sqrt(a / b)))


def rank(values, p):
    v = sorted(x for x in values if x > 0)
    return v[int(math.floor((len(v) - 1) * p))] if v else 0.0


KEY = lambda s: re.sub("[^a-z0-9]+", "", s.lower())


def plain_estimate(pair, entries, premium, family):
    """The estimator in plain Python. pair and entries: (collection, model, backdrop, floor, model rarity, backdrop rarity)."""
    entries = [e for e in entries if e[0] == pair[0] and e[3] > 0]
    if not entries:
        return None
    model = [e for e in entries if e[1] == pair[1]]
    back = [e for e in entries if e[2] == pair[2]]
    fam = [e for e in entries if family[pair[2]] and family[e[2]] == family[pair[2]]]
    tie = lambda e: e[6]
    near = sorted((e for e in entries if pair[5] > 0 and e[5] > 0 and e[5] >= pair[5]), key=lambda e: (e[5] - pair[5], tie(e)))[:12]
    direct = [(e, 0) for e in back] + [(e, 1) for e in near]
    pool = direct or [(e, 2) for e in entries]
    pool = [x for x in pool if not pair[4] or x[0][4] > 0]
    pool.sort(key=lambda x: (abs(x[0][4] - pair[4]) if pair[4] else 0, abs(premium[x[0][2]] - premium[pair[2]]), x[0][3], x[1], tie(x[0])))
    pool = [x[0] for x in pool[: 8 if direct else 14]]
    m_low = rank([e[3] for e in model], 0.25)
    adjusted = []
    for e in pool:
        v = e[3]
        if e[1] != pair[1]:
            low = rank([x[3] for x in entries if x[1] == e[1]], 0.25)
            if m_low > 0 and low > 0:
                v *= min(1.9, max(0.55, m_low / low))
            if pair[4] > 0 and e[4] > 0:
                v *= bridge(e[4], pair[4], 0.85, 1.25)
        if premium[pair[2]] > premium[e[2]]:
            v *= bridge(premium[pair[2]], premium[e[2]], 1, 1.22)
        adjusted.append(v)
    dark = family[pair[2]] == "dark"
    b_low, f_low = rank([e[3] for e in back], 0.25), rank([e[3] for e in fam], 0.45 if dark else 0.35)
    value = rank(adjusted, 0.35) or (math.sqrt(m_low * b_low) if m_low and b_low else math.sqrt(m_low * f_low) if m_low and f_low else m_low or b_low or f_low)
    if model and back and (pair[4] > 0 or pair[5] > 0):
        boost = lambda r, top, base, least: min(top, max(1, math.sqrt(base / max(r, least)))) if r > 0 else 1
        value *= min(1.35, boost(pair[4], 1.18, 5, 0.25) * boost(pair[5], 1.28, 4, 0.2))
    if not back and not fam:
        value *= min(1.08, max(0.9, premium[pair[2]]))
    floors = [e[3] for e in entries]
    value = min(rank(floors, 0.9) * (1.8 if dark else 1.35), max(rank(floors, 0), value))
    confidence = "medium" if len(model) >= 5 and len(back) >= 5 else "low" if len(model) >= 3 and (len(back) >= 2 or len(fam) >= 8) else "very-low"
    return value, confidence


def test_estimates_against_a_plain_model(spark):
    rng = random.Random(11)
    backs = ["Onyx Black", "Black", "Midnight Blue", "Ivory White", "Emerald", "Plain", "Gold Rush", "Sky", "Void"]
    premium = {b: spark.range(1).select(numbers.market_premium(F.lit(b))).first()[0] for b in backs}
    family = {b: spark.range(1).select(text.family(F.lit(b))).first()[0] for b in backs}
    entries, pairs = [], []
    for c in ("A", "B", "C"):
        for m in range(8):
            for b in backs[: 9 if c == "A" else 5]:
                if rng.random() < 0.6:
                    entries.append((c, f"m{m}", b, float(rng.randint(1, 400)), rng.choice([0.0, 0.5, 2.0, 3.0, 8.0]), rng.choice([0.0, 1.0, 2.0, 5.0])))
    for i in range(90):
        pairs.append((i, rng.choice("ABCD"), f"m{rng.randint(0, 9)}", rng.choice(backs), rng.choice([0.0, 0.5, 2.0, 8.0]), rng.choice([0.0, 1.0, 2.0])))
    schema = "collection string, model string, backdrop string, floor double, model_rarity double, backdrop_rarity double"
    e = spark.createDataFrame(entries, schema)
    ids = {tuple(r[:3]): r.h for r in e.select("collection", "model", "backdrop", F.concat_ws(":", *[text.key(F.col(c)) for c in R.COMBO]).alias("h")).collect()}
    with_tie = [(*x, ids[x[:3]]) for x in entries]
    got = {r.pair_id: r for r in V.estimate(spark.createDataFrame(pairs, "pair_id int, collection string, model string, backdrop string, model_rarity double, backdrop_rarity double"), e).collect()}
    assert len(got) == 90
    for i, c, m, b, mr, br in pairs:
        want = plain_estimate((c, m, b, None, mr, br), with_tie, premium, family)
        if want is None:
            assert got[i].estimate is None
        else:
            assert (got[i].estimate, got[i].confidence) == (pytest.approx(want[0], rel=1e-9), want[1]), (i, c, m, b, mr, br, got[i])


def test_collectibles_route(spark):
    listings = spark.createDataFrame([("C", "M", "B", "x", 77.0, "1"), ("C", "M", "B", "x", 80.0, "2"), ("C", "M", "T", "x", 5.0, "3"), ("C", "N", "B", "y", 50.0, "4"), ("C", "N", "B", "y", 51.0, "5")], "collection string, model string, backdrop string, market string, price double, listing_id string")
    sales = spark.createDataFrame([("C", "S", "B", "x", 9.0, T0, "s1"), ("C", "S", "B", "x", 8.0, T0 + dt.timedelta(1), "s2")], "collection string, model string, backdrop string, market string, price double, sold_at timestamp, sale_id string")
    traits = spark.createDataFrame([("C", "model", "M", 2.0), ("C", "backdrop", "B", 1.0)], "collection string, trait_type string, value string, rarity double")
    held = spark.createDataFrame([(1, "C", "M", "B"), (2, "C", "S", "B"), (3, "C", "M", "T"), (4, "Z", "M", "B"), (5, "C", "M", "B")], "asset_id int, collection string, model string, backdrop string")
    got = {r.asset_id: r for r in routes.wallet_collectibles(held, listings, sales, traits, F.lit(2.0)).collect()}
    assert [got[i].status for i in range(1, 6)] == ["priced", "last-sale", "estimated", "unavailable", "priced"]
    assert got[1].value == 77.0 and got[1].value_usd == 154.0 and got[2].value == 8.0 and got[3].ignored_floor == 5.0 and got[3].value > 0 and got[4].value == 0.0
    bulk = {(r.model, r.backdrop): r.status for r in routes.bulk_floors(held, listings).where("collection = 'C'").collect()}
    assert bulk == {("M", "B"): "priced", ("M", "T"): "thin", ("S", "B"): "pending"}
    tokens = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0)], "value double, balance double")
    s = routes.portfolio_summary(tokens, routes.wallet_collectibles(held, listings, sales, traits, F.lit(2.0))).first()
    assert (s.tokens, s.collectibles, s.unpriced) == (1, 5, 1) and s.total_value == pytest.approx(3.0 + 77 * 2 + 8 + got[3].value)
    assert routes.asset_detail(held, listings, sales, F.lit(T0 + dt.timedelta(1))).count() == 4


def test_wallet_history(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    moves = spark.createDataFrame([(1, at(0), 5.0), (1, at(30), -2.0)], "wallet long, at timestamp, amount double")
    quotes = spark.createDataFrame([(1, at(0), 2.0), (1, at(40), 4.0)], "wallet long, at timestamp, price double")
    got = [(r.bucket, r.value) for r in routes.wallet_history(moves, quotes, F.lit(at(47)), 3).orderBy("bucket").collect()]
    assert got == [(1, 10.0), (2, 20.0)]


def test_filters_and_classes(spark):
    rows = [(1, "", "", "", ["Model", "Backdrop", "Symbol"], ["x"], "", False), (2, "Cat stickers", "n", "", ["Edition"], ["x"], "", False), (3, "Cats", "airdrop claim", "", ["Model", "Backdrop", "Symbol"], ["x"], "", False), (4, "Cats", "n", "", [], [], "http://h/sticker/1", False), (5, "Plain", "n", "", ["Rarity"], ["Epic"], "", True), (6, "Plain", "n", "", None, None, None, None), (7, "Lost Dogs", "n", "", [], [], "", False)]
    df = spark.createDataFrame(rows, "id int, c string, n string, d string, t array<string>, v array<string>, i string, ok boolean")
    col = F.col
    got = [r.k for r in df.orderBy("id").select(H.classify(col("c"), col("n"), col("d"), col("t"), col("v"), col("i"), col("ok"), F.lit(False)).alias("k")).collect()]
    assert got == ["other", "sticker", "other", "sticker", "sticker", "other", "sticker"]
