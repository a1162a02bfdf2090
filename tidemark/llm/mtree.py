"""Exact top-k inner products by best-first search of M-trees, one per shard."""

from __future__ import annotations

import pickle
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import finite, first_of_each, scatter_search

#: Rows of a leaf page, and children of an inner page.
PAGE_ROWS, FANOUT = 64, 16


def build_tree(ids: np.ndarray, vecs: np.ndarray) -> bytes:
    """A shard's tree in flat arrays: nodes with a routing vector, its covering radius and its distance to the parent's,
    children side by side; leaf entries with their distance to the leaf's routing vector."""
    pivots, radii, to_parent, first, last, leaf = [], [], [], [], [], []
    order = np.empty(0, np.int64)
    pages: list[np.ndarray] = []
    filled = 0
    rng = np.random.default_rng(9)

    def node(members: np.ndarray, parent: np.ndarray | None) -> int:
        at = vecs[members]
        pivot = at[np.argmin(((at - at.mean(axis=0)) ** 2).sum(axis=1))]  # a member, that nearest to the mean
        pivots.append(pivot)
        radii.append(float(np.sqrt(((at - pivot) ** 2).sum(axis=1).max())))
        to_parent.append(0.0 if parent is None else float(np.sqrt(((pivot - parent) ** 2).sum())))
        first.append(0)
        last.append(0)
        leaf.append(False)
        return len(pivots) - 1

    todo = [(node(np.arange(len(ids)), None), np.arange(len(ids)))] if len(ids) else []
    for at, members in todo:  # grows as it goes: level by level
        if len(members) <= PAGE_ROWS:
            leaf[at], first[at] = True, filled
            pages.append(members)
            filled += len(members)
            last[at] = filled
            continue
        seeds = vecs[rng.choice(members, min(FANOUT, -(-len(members) // (PAGE_ROWS // 2))), replace=False)]
        mine = vecs[members]
        near = ((seeds**2).sum(axis=1)[None, :] - 2.0 * (mine @ seeds.T)).argmin(axis=1)
        groups = [members[near == s] for s in range(len(seeds))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # equal vectors
            groups = np.array_split(members, len(seeds))
        first[at] = len(pivots)
        todo += [(node(g, pivots[at]), g) for g in groups]
        last[at] = len(pivots)
    order = np.concatenate(pages) if pages else order
    rows = vecs[order]
    home = np.repeat([i for i in range(len(pivots)) if leaf[i]], [last[i] - first[i] for i in range(len(pivots)) if leaf[i]]) if pages else order
    pivot_rows = np.array(pivots).reshape(len(pivots), -1)
    spans = np.sqrt(((rows - pivot_rows[home]) ** 2).sum(axis=1)) if len(rows) else np.empty(0)
    return pickle.dumps((ids[order], rows.astype(np.int64), spans, pivot_rows, np.array(radii), np.array(to_parent), np.array(first), np.array(last), np.array(leaf)), protocol=5)


def search_tree(made: tuple, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Pages in falling order of their bound, until none can reach the k-th score found.

    A row within distance r of a routing vector p scores at most <q, p> + |q| r. Where r includes the stored distance to
    the parent's vector, the bound needs no product of its own; only pages that pass it are computed.
    """
    ids, rows, spans, pivots, radii, to_parent, first, last, leaf = made
    out: list[tuple[int, int, int]] = []
    exact = rows.astype(np.float64) if len(rows) and np.abs(rows).max() < 1 << 20 else None
    for qid, q in zip(query_ids.tolist(), queries, strict=True):
        if not len(ids):
            continue
        size = float(np.sqrt((q * q).sum()))
        slack = 1e-9 * (1 + size) * (1 + float(np.abs(pivots).max())) * len(q)
        whole = q.astype(np.int64)
        small = exact is not None and np.abs(whole).max() < 1 << 20 and len(q) <= 4096
        best_scores, best_ids = np.empty(0, np.int64), np.empty(0, np.int64)
        floor = -np.inf
        root = float(pivots[0] @ q)
        heap = [(-(root + size * radii[0]), 0, root)]
        while heap:
            bound, at, own = heappop(heap)
            if -bound + slack < floor:
                break
            a, b = first[at], last[at]
            if leaf[at]:
                near = np.flatnonzero(own + size * spans[a:b] + slack >= floor) + a
                if not len(near):
                    continue
                scores = np.rint(exact[near] @ q).astype(np.int64) if small else rows[near] @ whole
                ok = (scores >= floor) & (ids[near] != qid)
                best_scores, best_ids = np.concatenate((best_scores, scores[ok])), np.concatenate((best_ids, ids[near][ok]))
                top = np.lexsort((best_ids, -best_scores))
                top = top[first_of_each(best_ids[top], k)]
                best_scores, best_ids = best_scores[top], best_ids[top]
                if len(top) == k:
                    floor = best_scores[-1]
            else:
                kids = np.flatnonzero(own + size * (to_parent[a:b] + radii[a:b]) + slack >= floor) + a
                products = pivots[kids] @ q
                for child, product in zip(kids.tolist(), products.tolist(), strict=True):
                    reach = min(product + size * radii[child], own + size * (to_parent[child] + radii[child]))
                    if reach + slack >= floor:
                        heappush(heap, (-reach, child, product))
        out += [(qid, v, s) for v, s in zip(best_ids.tolist(), best_scores.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)


def top_products(vectors: DataFrame, query_filter, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192) -> DataFrame:
    """Each query's k highest inner products of floor(scale * x): query_id, rank, vec_id, score (long), exact.

    Vectors null, empty, or with null or non-finite components, and rows without an id, take no part; zero vectors do.
    Vectors are compared with those of their own length. Rows that repeat with id and vector are one candidate; an id
    with several vectors is one with the best of their scores, and asks with each. Products are exact while they fit a
    long. No rows give none.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & finite(v)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    rows = rows.distinct()
    queries = rows.where(query_filter(F.col("id")))
    return scatter_search(rows, queries, build_tree, search_tree, k, "long", False, shard_rows)
