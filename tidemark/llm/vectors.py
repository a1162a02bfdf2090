"""Scatter and gather for searches over sharded vector indexes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.runtime import ship


def finite(vec: Column) -> Column:
    """True if a vector is there, not empty, and all its components are numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def first_of_each(ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k distinct ids."""
    return np.sort(np.unique(ids, return_index=True)[1])[:k]


def scatter_search(
    vectors: DataFrame,
    queries: DataFrame,
    build: Callable[[np.ndarray, np.ndarray], bytes],
    search: Callable[[Any, np.ndarray, np.ndarray, int], pd.DataFrame],
    k: int,
    score_type: str,
    ascending: bool,
    shard_rows: int = 8192,
) -> DataFrame:
    """Search every shard for every query and merge: rows (query_id, rank, vec_id, score).

    ``vectors`` and ``queries`` have id long and v array, and no two equal rows. Vectors are dealt to shards of about
    ``shard_rows`` by a hash of the row, a shard per task; ``build`` makes an index of each shard's vectors of one length,
    which is checkpointed, so a lost executor doesn't build it again. An index stays where its shard is, and the queries
    stream past it in batches. Ties go to the smaller id; a query's own id is no candidate. An id with several vectors is
    one candidate with the best of their scores, and asks with each of them.
    """
    ship(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_rows))
    place = F.pmod(F.xxhash64("id", "v", F.lit(11)), F.lit(shards)).cast("int")
    dealt = vectors.select("id", "v", F.size("v").alias("dim"), place.alias("shard"))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "made": [made]})

    built = cut(dealt.repartitionById(shards, "shard").groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, made binary"))
    asked = queries.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("binary").alias("made"), "id", "v")
    both = built.select("dim", "shard", "made", F.lit(None).cast("long").alias("id"), F.lit(None).cast(queries.schema["v"].dataType).alias("v")).unionByName(asked)
    kinds = [pa.int64(), pa.int64(), pa.float64() if score_type == "double" else pa.int64()]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, loaded = None, None
        for batch in batches:
            dims, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.append(np.flatnonzero((dims[1:] != dims[:-1]) | (places[1:] != places[:-1])) + 1, batch.num_rows)
            a = 0
            for b in ends.tolist() if batch.num_rows else []:
                if (key := (dims[a], places[a])) != at:  # an index comes before its queries
                    at, loaded = key, None
                    if batch.column(2)[a].is_valid:
                        loaded = pickle.loads(batch.column(2)[a].as_py())
                        a += 1
                if a < b and loaded is not None:
                    v = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1).astype(np.float64)
                    hits = search(loaded, batch.column(3).slice(a, b - a).to_numpy(), v, k)
                    yield pa.RecordBatch.from_arrays([pa.array(hits[c].to_numpy(), t) for c, t in zip(("query_id", "vec_id", "score"), kinds, strict=True)], names=["query_id", "vec_id", "score"])
                a = b

    stream = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", F.col("made").isNull())
    hits = stream.mapInArrow(found, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
    one = hits.repartition("query_id").groupBy("query_id", "vec_id").agg((F.min if ascending else F.max)("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
