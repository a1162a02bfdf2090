"""Change-suppressed history: what is written, latest rows, ranges, retention, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import slice_of

HEARTBEAT_HOURS, OVERWRITE_MINUTES, RETENTION_DAYS, SERIES_POINTS, TOLERANCE = 23, 20, 370, 1500, 1e-6


def unchanged(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) <= tolerance


def fold(rows: DataFrame, keys: list[str], at: str = "sampled_at", value: str = "floor", ordinal: str = "event_id", heartbeat_hours: float = HEARTBEAT_HOURS, overwrite_minutes: float = OVERWRITE_MINUTES, suppress: bool = True, slice_hours: float = 24) -> DataFrame:
    """Rows that stay after each is held against the last one written: skipped if unchanged and younger than the heartbeat,
    else replacing it if that is younger than ``overwrite_minutes``, else added. ``suppress=False`` only overwrites.

    The value last written never differs from the row before by more than the tolerance. So a row that differs from it by
    over twice that is written whatever came before, as is one that comes a heartbeat later: keys are cut at such rows, the
    stretches of equal values folded apart, and a stretch's last row goes if the next one comes soon enough to replace it.
    Neighbours across slices of time are carried over, so only a run of equal values without a gap is one task's list.
    """
    wait, soon = int(max(heartbeat_hours * 3600, overwrite_minutes * 60) * 1e6), int(overwrite_minutes * 60 * 1e6)
    beat = int(heartbeat_hours * 3600 * 1e6)
    t, v = F.unix_micros(at), F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    place = F.struct(F.col(at).alias("t"), F.col(ordinal).alias("o"))
    point = F.struct(t.alias("t"), v.alias("v"))

    def apart(x: Column, y: Column) -> Column:
        far = (y["t"] - x["t"] >= wait) | (F.abs(y["v"] - x["v"]) > 2 * TOLERANCE) if suppress else F.lit(True)
        return F.coalesce(x.isNull() | far, F.lit(True))

    w = Window.partitionBy("__g").orderBy(at, ordinal)
    own = rows.select(*keys, at, value, ordinal, slice_of(keys, at, slice_hours).alias("__g")).withColumns({"__p": F.lag(point).over(w), "__n": F.lead(point).over(w)})
    own = own.withColumn("__c", F.when(F.col("__p").isNotNull() & apart(F.col("__p"), point), place))
    # A slice's first row is held against the last of the slice before; one row of each slice tells where its head belongs.
    each = own.groupBy("__g").agg(F.min_by(point, place).alias("first"), F.min(place).alias("head"), F.max_by(point, place).alias("last"), F.max("__c").alias("cut"))
    slices = Window.partitionBy(*[F.col("__g")[k] for k in keys]).orderBy(F.col("__g")["__s"])
    each = each.withColumns({"before": F.lag("last").over(slices), "__n0": F.lead("first").over(slices)})
    each = each.withColumn("head", F.when(apart(F.col("before"), F.col("first")), F.col("head")))
    past = F.last(F.coalesce("cut", "head"), True).over(slices.rowsBetween(Window.unboundedPreceding, -1))
    given = each.select("__g", "__n0", F.coalesce("head", past).alias("__h"))
    marked = own.withColumn("__s", F.last("__c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(given, "__g", "left")
    cut = marked.select(*keys, at, value, ordinal, F.coalesce("__n", "__n0")["t"].alias("__next"), F.coalesce("__s", "__h").alias("__s"))
    item = F.struct(t.alias("t"), F.col(ordinal).alias("o"), F.col(value).cast("double").alias("v"))
    lists = cut.groupBy(*keys, "__s").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.max_by(F.struct("__next"), place).alias("n"))
    empty = F.filter("xs", lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        age = x["t"] - last["t"]
        added = F.concat(acc, F.array(x))
        kept = (age < beat) & unchanged(last["v"], x["v"]) & F.lit(suppress)
        return F.when(F.size(acc) == 0, added).when(kept, acc).when(age < soon, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(added)

    written = lists.select(*keys, F.col("n.__next").alias("next"), F.aggregate("xs", empty, step).alias("ys"))
    replaced = F.coalesce(F.col("next") - F.element_at("ys", -1)["t"] < soon, F.lit(False))
    out = written.select(*keys, F.explode(F.when(replaced, F.slice("ys", 1, F.size("ys") - 1)).otherwise(F.col("ys"))).alias("x"))
    return out.select(*keys, F.timestamp_micros("x.t").alias(at), F.col("x.v").alias(value), F.col("x.o").alias(ordinal))


def latest(rows: DataFrame, keys: list[str], at: str = "sampled_at", ordinal: str = "event_id") -> DataFrame:
    """The newest row of each key; pre-aggregated, without a window."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(at, ordinal)).alias("__r")).select("__r.*")


def history(rows: DataFrame, keys: list[str], as_of: Column, days: int, at: str = "sampled_at", value: str = "floor") -> DataFrame:
    """Positive points of the last ``days``; a series of fewer than two is empty."""
    inside = rows.where((F.col(value) > 0) & (F.col(at) >= as_of - F.expr(f"interval {days} days")) & (F.col(at) <= as_of))
    many = inside.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n >= 2").drop("__n")
    return inside.join(many, keys, "left_semi")


def retain(rows: DataFrame, as_of: Column, days: int = RETENTION_DAYS, at: str = "sampled_at") -> DataFrame:
    return rows.where(F.col(at) >= as_of - F.expr(f"interval {days} days"))


def last_points(rows: DataFrame, keys: list[str], n: int = SERIES_POINTS, at: str = "sampled_at", ordinal: str = "event_id") -> DataFrame:
    """The newest ``n`` rows of each key, oldest first by the caller's order."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(ordinal).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def upsert_headers(old: DataFrame, new: DataFrame, key: str = "collection_key") -> DataFrame:
    """Header rows: the new name always, the new external id unless blank, the new sales unless an empty list."""
    o = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("name", "external_id", "recent_sales")])
    j = o.join(new, o["__k"] == new[key], "full")
    has = F.col(key).isNotNull()
    keep = lambda c, blank: F.when(has & ~F.coalesce(F.col(c), F.lit(blank)).isin(blank), F.col(c)).otherwise(F.col(f"__{c}"))
    return j.select(F.coalesce(key, "__k").alias(key), F.when(has, F.col("name")).otherwise(F.col("__name")).alias("name"), keep("external_id", "").alias("external_id"), keep("recent_sales", "[]").alias("recent_sales"))


def store_status(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("collection").alias("collections"), F.countDistinct("collection", "model").alias("models"), F.count("*").alias("points"), F.max("sampled_at").alias("latest_at"))


def storage_level(percent: Column) -> Column:
    return F.when(percent >= 95, "critical").when(percent >= 80, "high").when(percent >= 60, "watch").otherwise("ok")


def append_capped(old: DataFrame, new: DataFrame, at: str, ordinal: str, cap: int = 5000) -> DataFrame:
    """Both, newest ``cap`` rows only."""
    return old.unionByName(new).orderBy(F.col(at).desc(), F.col(ordinal).desc()).limit(cap)
