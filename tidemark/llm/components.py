"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

ROWS_PER_FILE = 250_000


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction. Rows (a, b) with a > b in; rows of the same form out.

    Minima are pre-aggregated before the shuffle, and the join back may split a hot node over tasks.
    """
    if large:
        pairs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = pairs.groupBy("a").agg(F.min("b").alias("m"))
    joined = pairs.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of long ids to rows (node, root): every node that has an edge to another, and the least id it reaches.

    Null ends and self-loops are ignored; repeated edges don't matter; no edges give no rows.
    Each round is checkpointed; the loop ends when a round changes nothing.
    """
    cur = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    state = None
    while True:
        got = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == state or not got[0]:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = tuple(got)
        # A round makes at most about twice the rows, so few rows need few checkpoint files.
        cur = cut(_star(_star(cur, True), False).coalesce(max(1, 2 * got[0] // ROWS_PER_FILE)))
