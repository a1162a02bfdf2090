"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered

#: Entries of all sources' distributions that may be broadcast (8 bytes each), once summed; beyond it they are joined by a shuffle.
BROADCAST_ENTRIES = 1 << 20


def uniform(seed: int, *parts: str | Column) -> Column:
    """Uniform in [0, 1) from 52 bits of an MD5 over the seed and the parts (null as empty)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cdf_entries(rate: Column) -> Column:
    """Length of a rate's table: it ends beyond any 52-bit uniform."""
    return F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int") + 1).otherwise(1)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Rows (source, rate) with cdf: the array of P(X <= k) for k from 0; summed in logarithms, so large rates don't underflow."""
    rate, k = F.col("rate"), F.col("k").cast("double")
    steps = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), cdf_entries(rate) - 1)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = steps.withColumn("log_p", F.sum(F.when(F.col("k") > 0, F.log(rate) - F.log(k)).otherwise(-rate)).over(upto))
    sums = logs.withColumn("cdf", F.sum(F.exp("log_p")).over(upto))
    return sums.groupBy("source", "rate").agg(F.sort_array(F.collect_list(F.struct("k", "cdf")))["cdf"].alias("cdf"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, source_col: str = "source", total: float | None = None) -> DataFrame:
    """One row (source, n, rate) per source; rate is the mean number of copies that makes sources meet their targets.

    Targets: ``weights`` (sources left out get 0), or the counts to ``power``; they are scaled to ``total`` rows in the
    mean, by default as many as there are. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    weighed = counts.withColumn("w", target)
    sums = weighed.agg(F.sum("w").alias("sum_w"), F.sum("n").cast("double").alias("sum_n"))
    goal = F.lit(float(total)) if total is not None else F.col("sum_n")
    rate = F.when(F.col("sum_w") > 0, F.col("w") / F.col("sum_w") * goal / F.col("n")).otherwise(F.lit(0.0))
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, seed: int = 17, source_col: str = "source", total: float | None = None) -> DataFrame:
    """Each row repeated by an inverted Poisson draw, in a global random order; adds copy (from 0), copies, rate and mix_order.

    A row's draw depends on the seed, its values in all columns, and its number among rows equal to it; so rows of one id,
    or of none, draw each for themselves, and a rerun or a lost executor changes nothing. Rows are dealt to partitions by a
    hash of that and of the copy's number, and lie in the order of mix_order within them. Null ids and null or empty texts
    are values as any other; columns of the names added are replaced; no rows give none.
    """
    base = docs.drop("copy", "copies", "rate", "mix_order")
    rates = source_rates(base, weights, power, source_col, total).select("source", "rate")
    table = poisson_tables(rates).select(F.col("source").alias("__src"), "rate", F.col("cdf").alias("__cdf"))
    entries = rates.agg(F.sum(cdf_entries(F.col("rate")).cast("long"))).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        table = F.broadcast(table)
    drawn = numbered(base).join(table, F.col(source_col).eqNullSafe(F.col("__src"))).drop("__src")
    drawn = drawn.withColumn("__u", uniform(seed, "__row", "__occ"))
    drawn = drawn.withColumn("copies", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))).cast("long")).drop("__cdf", "__u")
    each = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "__row", F.col("__occ").cast("string"), F.col("copy").cast("string")).cast("binary"))
    return each.withColumn("mix_order", order).drop("__row", "__occ").repartition("mix_order").sortWithinPartitions("mix_order")
