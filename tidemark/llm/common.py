"""Shared folders, checkpoints and stable row keys for the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 48 bytes that may be broadcast, once counted; and how many occurrences of a row one task counts out.
BROADCAST_ROWS, OCCURRENCE_BLOCK = 200_000, 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or that set with setCheckpointDir; where both are unset, one under the
    warehouse, which every node of a cluster sees as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.tidemark-checkpoints-{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def identity(columns: list[str]) -> Column:
    """MD5 in hex over the columns' MD5s, in the order of their names; a null differs from any value."""
    parts = [F.md5(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")).cast("binary")) for c in sorted(columns)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with __row, the identity of all its columns, and __occ, the number from 0 of a row among those equal to it.

    Only rows that repeat are touched: they are first made one with their count, so a hot row costs one row per task, and
    then counted out in blocks that may lie on any task. The list of repeating identities is broadcast up to a counted size.
    """
    names = [f"`{c}`" for c in df.columns]
    keyed = df.withColumn("__row", identity(df.columns))
    often = cut(keyed.groupBy("__row").agg(F.count("*").alias("__n")).where("__n > 1"))
    repeats = often.count()
    if not repeats:
        return keyed.withColumn("__occ", F.lit(0).cast("long"))
    joined = keyed.join(F.broadcast(often) if repeats <= BROADCAST_ROWS else often, "__row", "left")
    single = joined.where(F.col("__n").isNull()).select(*names, "__row", F.lit(0).cast("long").alias("__occ"))
    one = joined.where(F.col("__n").isNotNull()).groupBy("__row").agg(F.first("__n").alias("__n"), *[F.first(n).alias(c) for n, c in zip(names, df.columns, strict=True)])
    blocks = one.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(OCCURRENCE_BLOCK)))).repartition("__row", "__at")
    each = F.explode(F.sequence("__at", F.least(F.col("__n"), F.col("__at") + OCCURRENCE_BLOCK) - 1))
    return single.unionByName(blocks.select(*names, "__row", each.alias("__occ")))


def row_key(*columns: str | Column) -> Column:
    """64-bit hash of a row's identity; nulls are skipped by the hash, so a null differs from any value."""
    return F.xxhash64(*columns)
