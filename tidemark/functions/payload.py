"""Semi-structured payloads as VARIANT: candidate paths and a bounded walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_path(payload: Column, paths: list[str], kind: str = "string") -> Column:
    """Value of the first path that is there and of the kind."""
    return F.coalesce(*[F.try_variant_get(payload, p, kind) for p in paths])


def first_positive_path(payload: Column, paths: list[str]) -> Column:
    values = [F.try_variant_get(payload, p, "double") for p in paths]
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def trait(attributes: Column, label: str) -> Column:
    """Trimmed value of the first trait (struct of trait_type and value) with a label, whatever its case."""
    hit = F.filter(attributes, lambda t: F.lower(t["trait_type"]) == label)
    return F.when(F.size(hit) > 0, F.trim(F.get(hit, 0)["value"])).otherwise("")


def walk(rows: DataFrame, payload_col: str, depth: int = 6) -> DataFrame:
    """Every object and array below a payload, level by level to ``depth``: columns of ``rows``, level, node.

    The levels are a fixed number of generators, not a loop over data, so it stays one plan.
    """
    keep = [c for c in rows.columns if c != payload_col]
    level = rows.select(*keep, F.lit(0).alias("level"), F.col(payload_col).alias("node"))
    out = level
    for i in range(1, depth + 1):
        view = level.select(*keep, "node")
        below = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("node").outer())).select(*keep, F.lit(i).alias("level"), F.col("value").alias("node"))
        level = below.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
        out = out.unionByName(level)
    return out
