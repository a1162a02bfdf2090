"""Every query with SQL against DuckDB, on the small tables."""

import math
from collections import Counter

import duckdb
import pytest

from tidemark import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert rows(df.columns, df.collect()) == want and want


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("combo_floor", "snapshot_fold", "nearest_price", "balance_at_date", "quality_gate", "valuation_cascade", "estimate_floor", "tier_match", "sales_top5", "series_change"):
        assert catalogue.queries()[name](spark, str(tmp_path)).count() == 0


ODD_EVENTS = """SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 11 = 0 AND event_type = 'view' THEN NULL ELSE value END AS value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id)
FROM events"""


def on_odd_events(spark, duck, path, name, change=ODD_EVENTS):
    """Rows of the query and of its SQL over changed events."""
    duck.execute(f"COPY ({change}) TO '{path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    df = catalogue.queries()[name](spark, str(path))
    cur = con.execute(catalogue.oracle_sql()[name])
    return rows(df.columns, df.collect()), rows([c[0] for c in cur.description], cur.fetchall())


def test_nearest_price_of_zero_is_a_price(spark, duck, tmp_path):
    got, want = on_odd_events(spark, duck, tmp_path, "nearest_price")
    assert got == want and any(r[1] == 0 for r in want)


def test_fresh_price_of_zero_is_a_price(spark, duck, tmp_path):
    got, want = on_odd_events(spark, duck, tmp_path, "nearest_price_fresh", ODD_EVENTS.replace("THEN NULL ELSE value", "THEN 0.0 ELSE value"))
    assert got == want and any(r[1] == 0 for r in want)


def test_gain_over_a_first_value_of_zero(spark, duck, tmp_path):
    change = """SELECT * REPLACE (CASE WHEN user_id % 10 = 1 OR nth = 1 AND user_id % 10 = 2 THEN 0.0 WHEN user_id % 10 = 3 THEN -value WHEN nth % 3 = 1 AND user_id % 10 = 4 OR user_id % 10 = 5 THEN NULL ELSE value END AS value)
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM events)"""
    got, want = on_odd_events(spark, duck, tmp_path, "range_pnl", change)
    assert got == want and any(math.isinf(x) for r in want for x in r if x is not None)


OUTGOING = """SELECT * REPLACE (CASE WHEN user_id % 3 = 0 AND event_type IN ('purchase', 'signup') THEN 'click' ELSE event_type END AS event_type)
FROM events WHERE event_type = 'view' OR ts < TIMESTAMP '2024-01-12'"""


@pytest.mark.parametrize(
    "name,change",
    [
        ("portfolio_history", "SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id) FROM events"),
        ("balance_at_date", "SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id) FROM events"),
        ("portfolio_history", "SELECT * REPLACE (CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts) FROM events"),
        ("balance_at_date", "SELECT * REPLACE (CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts) FROM events"),
        ("portfolio_history", "SELECT * REPLACE (date_trunc('day', ts) AS ts) FROM events"),
        ("portfolio_history", OUTGOING),
    ],
    ids=["values, no wallet", "balances, no wallet", "values, no time", "balances, no time", "values, quotes at one instant", "values, only outgoing"],
)
def test_balances_and_values_of_odd_events(spark, duck, tmp_path, name, change):
    """The SQL over exact decimals on one thread: over doubles it leaves rests such as 1e-13, and counts them as priced."""
    duck.execute(f"COPY ({change}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (value::DECIMAL(18, 2) AS value) FROM '{tmp_path}/events.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    cur = con.execute(catalogue.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(df.columns, df.collect()) == want and want
