"""Time series: grids, nearest prices, balances rolled back from a ledger, portfolio values, peaks and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def interval_grid(one: DataFrame, start: Column, end: Column, buckets: int, step_hours: int) -> DataFrame:
    """(bucket, at): ``buckets`` equal stretches, sampled every ``step_hours``; the last is the end alone."""
    a, b = F.unix_micros(start), F.unix_micros(end)
    span = F.greatest(F.lit(1), b - a)
    edge = lambda i: (a + span * i / (buckets - 1)).cast("long")
    base = one.select(a.alias("a"), b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    a, b, i = F.col("a"), F.col("b"), F.col("bucket")
    span = F.greatest(F.lit(1), b - a)
    step = step_hours * HOUR
    times = F.filter(F.sequence(edge(i), F.greatest(edge(i), F.least(edge(i + 1) - 1, b)), F.lit(step).cast("long")), lambda t: t <= b)
    return base.select("bucket", F.explode(F.when(i == buckets - 1, F.array(b)).otherwise(times)).alias("t")).select("bucket", F.timestamp_micros("t").alias("at"))


def daily_grid(one: DataFrame, now: Column, days: int, step_hours: int = 6) -> DataFrame:
    """(bucket, at): the last ``days`` UTC days up to now, every ``step_hours``, and now itself."""
    today = F.unix_micros(F.date_trunc("day", now))
    base = one.select(F.unix_micros(now).alias("n"), today.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("bucket"))
    first = F.col("d") - (days - 1 - F.col("bucket")) * 24 * HOUR
    times = F.filter(F.sequence(first, first + 23 * HOUR, F.lit(step_hours * HOUR).cast("long")), lambda t: t <= F.col("n"))
    times = F.when(F.col("bucket") == days - 1, F.array_union(times, F.array("n"))).otherwise(times)
    return base.select("bucket", F.explode(times).alias("t")).select("bucket", F.timestamp_micros("t").alias("at"))


def monthly_grid(one: DataFrame, now: Column, months: int = 13, step_hours: int = 6) -> DataFrame:
    """(bucket, at): the last ``months`` calendar months up to now, every ``step_hours``, and now itself."""
    base = one.select(now.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("bucket"))
    first = F.add_months(F.date_trunc("month", "n"), F.col("bucket") - (months - 1)).cast("timestamp")
    last = F.least(F.add_months(first, 1).cast("timestamp"), F.col("n"))
    times = F.filter(F.sequence(first, last, F.expr(f"interval {step_hours} hours")), lambda t: t < last)
    times = F.when(F.col("bucket") == months - 1, F.array_union(times, F.array("n"))).otherwise(times)
    return base.select("bucket", F.explode(times).alias("at"))


def slice_of(keys: list[str], at: str, hours: float) -> Column:
    """Keys and the number of the stretch of time that ``at`` lies in, as a struct: as such, nulls are equal to nulls."""
    return F.struct(*keys, F.floor(F.unix_micros(F.col(at).cast("timestamp")) / int(hours * HOUR)).alias("__s"))


def carried(rows: DataFrame, keys: list[str], aggs: dict[str, Column], given: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with what other slices of the same key hand over; ``rows`` has its ``slice_of`` as __g, which is dropped.

    ``aggs`` sums up a slice; ``given`` names, for each added column, one of them and how it comes over: the ``sum`` or
    ``last`` of the slices before, or the ``first`` of those after. Only summaries of slices, a row each, are laid out by
    key alone, so a key with a third of all rows is spread over as many tasks as it has slices. Windows over __g that
    come before share their exchange and order with the join here.
    """
    w = Window.partitionBy(*[F.col("__g")[k] for k in keys]).orderBy(F.col("__g")["__s"])
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ways = {"sum": lambda c: F.sum(c).over(before), "last": lambda c: F.last(c, True).over(before), "first": lambda c: F.first(c, True).over(after)}
    each = rows.groupBy("__g").agg(*[c.alias(n) for n, c in aggs.items()])
    return rows.join(each.select("__g", *[ways[way](name).alias(out) for out, (name, way) in given.items()]), "__g", "left").drop("__g")


def trim_grid(grid: DataFrame, moves: DataFrame, now: Column) -> DataFrame:
    """(wallet, bucket, at): each wallet's grid from its first movement on, with its movements put into their buckets.

    ``moves`` has wallet and at. The starts of the buckets are one short array, in which each movement finds its bucket.
    """
    firsts = moves.groupBy("wallet").agg(F.min("at").alias("first"))
    each = firsts.crossJoin(F.broadcast(grid))  # a grid has at most a few hundred rows
    starts = grid.groupBy("bucket").agg(F.min("at").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "bucket"))).alias("starts"))
    inside = moves.where(F.col("at") <= now).select("wallet", "at").crossJoin(F.broadcast(starts))  # one row
    held = F.filter("starts", lambda x: x["at"] <= F.col("at"))
    extra = inside.select("wallet", F.try_element_at(held, F.lit(-1))["bucket"].alias("bucket"), "at").where(F.col("bucket").isNotNull())
    return each.where((F.col("at") >= F.col("first")) & (F.col("at") <= now)).select("wallet", "bucket", "at").unionByName(extra).distinct()


def _between(probes: DataFrame, quotes: DataFrame, key: str, slice_hours: float) -> DataFrame:
    """Probes (p, t) with the quotes (t, price) next before or at them, a, and next after or at them, b; null where none.

    Quotes and probes are laid out in one order per key and slice of time; where a slice has no quote on one side of a
    probe, the nearest slice's does. No range join. Of quotes at one instant, a is the dearest and b the cheapest.
    """
    none = F.lit(None).cast("struct<t:bigint,price:double>")
    micros = F.unix_micros("at")
    p = probes.select(F.struct("*").alias("p"), F.col(key).alias("k"), "at", micros.alias("t"), F.lit(1).alias("kind"), none.alias("q"))
    q = quotes.select(F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.col(key).alias("k"), "at", micros.alias("t"), F.lit(0).alias("kind"), F.struct(micros.alias("t"), F.col("price").cast("double").alias("price")).alias("q"))
    w = Window.partitionBy("__g").orderBy("t", "kind", "q.price")
    a, b = F.last("q", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("q", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    # A probe comes after the quotes of its own instant, so those are looked up among the ones before.
    own = p.unionByName(q).withColumn("__g", slice_of(["k"], "at", slice_hours)).withColumns({"a": a, "b": b})
    both = carried(own, ["k"], {"lo": F.min("q"), "hi": F.max("q")}, {"a0": ("hi", "last"), "b0": ("lo", "first")})
    return both.where("kind = 1").select("p", "t", F.coalesce("a", "a0").alias("a"), F.coalesce("b", "b0").alias("b"))


def nearest_price(probes: DataFrame, quotes: DataFrame, key: str = "wallet", max_stale_hours: float | None = None, fallback: Column | None = None, slice_hours: float = 24, zero_is_price: bool = False) -> DataFrame:
    """``probes`` (key, at, ...) with the quote nearest in time, before or after; of equal gaps, the earlier.

    A price of zero, unless ``zero_is_price``, or beyond the limit, falls through to ``fallback``. Quotes without a price are none.
    """
    both = _between(probes, quotes.where(F.col("price").isNotNull()), key, slice_hours)
    gap_a, gap_b = F.col("t") - F.col("a.t"), F.col("b.t") - F.col("t")
    found = both.withColumn("hit", F.when(F.col("b").isNull() | (gap_a <= gap_b), F.col("a")).otherwise(F.col("b")))
    price = F.col("hit.price")
    if max_stale_hours is not None:
        price = F.when(F.abs(F.col("hit.t") - F.col("t")) <= int(max_stale_hours * HOUR), price)
    if not zero_is_price:
        price = F.when(price != 0, price)
    return found.select("p.*", F.coalesce(price, fallback if fallback is not None else F.lit(None)).cast("double").alias("price"))


def interpolated(probes: DataFrame, points: DataFrame, key: str = "wallet", slice_hours: float = 24) -> DataFrame:
    """Linear interpolation between the points around each probe, held at the ends."""
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    value = F.when(F.col("a").isNull(), F.col("b.price")).when(F.col("b").isNull() | (F.col("b.t") == F.col("a.t")), F.col("a.price")).otherwise(F.col("a.price") + (F.col("b.price") - F.col("a.price")) * share)
    return _between(probes, points, key, slice_hours).select("p.*", value.alias("price"))


def balances(probes: DataFrame, moves: DataFrame, current: DataFrame | None = None, slice_hours: float = 24) -> DataFrame:
    """``probes`` (wallet, at, ...) with the balance then: the current one less all later movements, not under zero.

    ``current`` has wallet and balance, by default the sum of all movements, at least 0. A wallet that holds nothing now
    but had movements in is summed forwards instead. A running sum per wallet and slice of time goes on from the sums of
    the slices before; no range join. The sum of no later movements is 0 to the last bit, whatever the order of the sums.
    Movements of no wallet are nobody's; those without a time count in the total, but are neither earlier nor later.
    """
    moves = moves.where(F.col("wallet").isNotNull())
    dated = F.when(F.col("at").isNotNull(), F.col("amount"))
    totals = moves.groupBy("wallet").agg(F.sum("amount").alias("total"), F.count_if(F.col("amount") > 0).alias("ins"), F.sum(dated).alias("dated"), F.count(dated).alias("n"))
    held = current.select("wallet", "balance") if current is not None else totals.select("wallet", F.greatest("total", F.lit(0.0)).alias("balance"))
    p = probes.select(F.struct("*").alias("p"), "wallet", "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("amount"))
    m = moves.where(F.col("at").isNotNull()).select(F.lit(None).cast(p.schema["p"].dataType).alias("p"), "wallet", "at", F.lit(0).alias("kind"), "amount")
    w = Window.partitionBy("__g").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = p.unionByName(m).withColumn("__g", slice_of(["wallet"], "at", slice_hours)).withColumns({"part": F.sum("amount").over(w), "part_n": F.count("amount").over(w)})
    both = carried(own, ["wallet"], {"whole": F.sum("amount"), "whole_n": F.count("amount")}, {"before": ("whole", "sum"), "before_n": ("whole_n", "sum")}).where("kind = 1")
    run = both.withColumn("run", F.coalesce("before", F.lit(0.0)) + F.coalesce("part", F.lit(0.0))).withColumn("run_n", F.coalesce("before_n", F.lit(0)) + F.col("part_n"))
    j = run.join(totals, "wallet", "left").join(held, "wallet", "left")
    now = F.coalesce("balance", F.lit(0.0))
    later = F.when(F.col("run_n") < F.col("n"), F.coalesce("dated", F.lit(0.0)) - F.col("run")).otherwise(0.0)
    value = F.when((now == 0) & (F.coalesce("ins", F.lit(0)) > 0), F.col("run")).otherwise(now - later)
    return j.select("p.*", F.greatest(value, F.lit(0.0)).alias("balance"))


def portfolio(probes: DataFrame, moves: DataFrame, quotes: DataFrame, max_stale_hours: float | None = None) -> DataFrame:
    """``probes`` with balance, nearest price and value; unpriced holdings are worth nothing."""
    priced = nearest_price(balances(probes, moves), quotes, "wallet", max_stale_hours)
    return priced.withColumn("value", F.col("balance") * F.coalesce("price", F.lit(0.0)))


def peaks(points: DataFrame, keys: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """The point of highest value in each bucket; the first of equals."""
    return points.groupBy(*keys).agg(F.min_by(F.struct(at, value), F.struct((-F.col(value)).alias("v"), at)).alias("x")).select(*keys, "x.*")


def changes(points: DataFrame, keys: list[str], at: str = "at", value: str = "value", ordinal: str | None = None, slice_hours: float = 24) -> DataFrame:
    """Percent change to the point before, over at least 1; 0 for the first."""
    order = [at, *([ordinal] if ordinal else [])]
    point = F.struct(F.col(value).alias("v"))  # a struct, so that a null value is a point too
    near = F.lag(point).over(Window.partitionBy("__g").orderBy(*order))
    own = points.withColumn("__g", slice_of(keys, at, slice_hours)).withColumn("__near", near)
    known = carried(own, keys, {"end": F.max_by(point, F.struct(*order))}, {"__far": ("end", "last")})
    before = F.coalesce("__near", "__far")["v"]
    change = F.coalesce((F.col(value) - before) / F.greatest(F.lit(1.0), before) * 100, F.lit(0.0))
    return known.withColumn("change_pct", change).drop("__near", "__far")


def range_result(points: DataFrame, keys: list[str], at: str = "at", value: str = "value", over_zero: bool = True) -> DataFrame:
    """First, last, gain and gain in percent of each series; points without a value are none.

    ``over_zero`` gives no percent, 0, over a first value of 0 or less; without it the gain is divided as floating numbers
    are, so over 0 it is infinite, or NaN for no gain.
    """
    known = F.when(F.col(value).isNotNull(), F.col(at))
    g = points.groupBy(*keys).agg(F.min_by(value, known).alias("first_value"), F.max_by(value, known).alias("last_value"))
    first, gain = F.col("first_value"), F.col("last_value") - F.col("first_value")
    pct = F.when(first == 0, gain * float("inf")).otherwise(F.try_divide(gain, first) * 100)
    return g.withColumns({"gain": gain, "gain_pct": F.when(first > 0, pct).otherwise(0.0) if over_zero else pct})


def extremes(points: DataFrame, keys: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """Lowest and highest point; suppressed where any value is over 20 times the last."""
    t = F.struct(value, at)
    g = points.groupBy(*keys).agg(F.min_by(F.struct(at, value), t).alias("lo"), F.max_by(F.struct(at, value), t).alias("hi"), F.max_by(value, at).alias("last"))
    wild = F.col(f"hi.{value}") > 20 * F.col("last")
    return g.select(*keys, *[F.when(~wild, F.col(f"{s}.{c}")).alias(f"{n}_{'at' if c == at else 'value'}") for s, n in (("lo", "low"), ("hi", "high")) for c in (at, value)])


def pin_last(points: DataFrame, keys: list[str], current: Column, at: str = "at", value: str = "value") -> DataFrame:
    """The last point of each series set to the current value; of several at that instant, one."""
    whole = F.struct(*keys)  # as a struct, nulls are equal to nulls
    ends = points.groupBy(whole.alias("__g")).agg(F.max(at).alias("__end"))
    known = points.withColumn("__g", whole).join(ends, "__g").drop("__g")
    # Only points of one instant are numbered together.
    first = F.row_number().over(Window.partitionBy(*keys, at).orderBy(F.col(value).desc())) == 1
    pinned = F.when(F.col("__first") & F.col(at).eqNullSafe(F.col("__end")), current).otherwise(F.col(value))
    return known.withColumn("__first", first).withColumn(value, pinned).drop("__end", "__first")


def day_headers(rows: DataFrame, keys: list[str], at: str = "at", ordinal: str = "event_id") -> DataFrame:
    """The day of each row that is the first of its day in newest-first order, else null; ordered within days only."""
    day = F.to_date(at)
    w = Window.partitionBy(*keys, day).orderBy(F.col(at).desc(), F.col(ordinal).desc())
    return rows.withColumn("header", F.when(F.row_number().over(w) == 1, day))


def best_source(points: DataFrame, keys: list[str], rank: str = "source_rank") -> DataFrame:
    """Of several sources of one series, the best-ranked that has more than one point."""
    usable = points.groupBy(*keys, rank).agg(F.count("*").alias("n")).where("n > 1").groupBy(*keys).agg(F.min(rank).alias(rank))
    return points.join(usable, [*keys, rank], "left_semi")
