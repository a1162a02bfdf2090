"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, in flat arrays."""

from __future__ import annotations

import pickle
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import finite, scatter_search

#: Links of a node: above the ground layer, on it, and how many more it may gather before they are thinned out.
LINKS, GROUND_LINKS, SLACK = 12, 24, 12
#: Nodes kept while building and while searching.
BUILD_WIDTH, SEARCH_WIDTH = 64, 192


class Graph:
    """A layer's links lie in one array, a row of ids per node; -1 where there are no more."""

    def __init__(self, vecs: np.ndarray, seed: int = 5):
        self.vecs = vecs.astype(np.float32)
        self.norms = np.einsum("ij,ij->i", self.vecs, self.vecs)
        n = len(vecs)
        self.level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64), 15)
        self.links = [np.full((n, (LINKS if layer else GROUND_LINKS) + SLACK), -1, np.int32) for layer in range(int(self.level.max(initial=0)) + 1)]
        self.counts = [np.zeros(n, np.int32) for _ in self.links]
        self.entry = -1

    def near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square."""
        return self.norms[ids] - 2.0 * (self.vecs[ids] @ q)

    def descend(self, q: np.ndarray, layer: int, start: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
        """Best-first search of a layer; the ``width`` nearest found, in no order."""
        links, counts = self.links[layer], self.counts[layer]
        seen = np.zeros(len(self.vecs), bool)
        seen[[i for _, i in start]] = True
        todo = list(start)
        heapify(todo)
        kept = [(-d, i) for d, i in start]
        heapify(kept)
        while todo:
            d, i = heappop(todo)
            if d > -kept[0][0] and len(kept) >= width:
                break
            out = links[i, : counts[i]]
            out = out[~seen[out]]
            if not len(out):
                continue
            seen[out] = True
            for e, j in zip(self.near(q, out).tolist(), out.tolist(), strict=True):
                if len(kept) < width:
                    heappush(kept, (-e, j))
                    heappush(todo, (e, j))
                elif e < -kept[0][0]:
                    heapreplace(kept, (-e, j))
                    heappush(todo, (e, j))
        return [(-d, i) for d, i in kept]

    def spread(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, those nearer to a chosen one than to the node pass; the places left go to the nearest of them."""
        order = np.argsort(dist, kind="stable")
        ids, dist = ids[order], dist[order]
        v = self.vecs[ids]
        between = self.norms[ids][:, None] + self.norms[ids][None, :] - 2.0 * (v @ v.T)
        shade = np.full(len(ids), np.inf, np.float32)
        chosen: list[int] = []
        for a in range(len(ids)):
            if shade[a] > dist[a]:
                chosen.append(a)
                if len(chosen) == most:
                    break
                np.minimum(shade, between[a], out=shade)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [a for a in range(len(ids)) if a not in taken][: most - len(chosen)]
        return ids[chosen]

    def link(self, i: int, j: int, layer: int) -> None:
        """Add j to i's links; thin them out where the row is full."""
        row, most = self.links[layer][i], LINKS if layer else GROUND_LINKS
        n = self.counts[layer][i]
        if n < len(row):
            row[n] = j
            self.counts[layer][i] = n + 1
            return
        ids = np.append(row, j)
        kept = self.spread(ids, self.near(self.vecs[i], ids) + self.norms[i], most)
        row[:] = -1
        row[: len(kept)] = kept
        self.counts[layer][i] = len(kept)

    def add(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        q = self.vecs[i]
        at = [(float(self.near(q, np.array([self.entry]))[0]), self.entry)]
        highest = int(self.level[self.entry])
        for layer in range(highest, top, -1):
            at = [min(self.descend(q, layer, at, 1))]
        for layer in range(min(top, highest), -1, -1):
            at = self.descend(q, layer, at, BUILD_WIDTH)
            ids = np.array([j for _, j in at], np.int64)
            dist = np.array([d for d, _ in at], np.float32) + self.norms[i]
            for j in self.spread(ids, dist, LINKS).tolist():
                self.link(i, j, layer)
                self.link(j, i, layer)
        if top > highest:
            self.entry = i

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        q = q.astype(np.float32)
        at = [(float(self.near(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = [min(self.descend(q, layer, at, 1))]
        return np.array([i for _, i in self.descend(q, 0, at, width)], np.int64)


def build_graph(ids: np.ndarray, vecs: np.ndarray) -> bytes:
    """A shard's index: equal vectors are one node, with the ids that have it in rising order."""
    order = np.lexsort((ids, *vecs.T[::-1]))
    ids, vecs = ids[order], vecs[order]
    new = np.concatenate(([True], (vecs[1:] != vecs[:-1]).any(axis=1)))
    starts = np.append(np.flatnonzero(new), len(ids))
    nodes = vecs[starts[:-1]]
    mix = np.random.default_rng(3).permutation(len(nodes))  # as sorted, neighbours would come in one after the other
    graph = Graph(nodes[mix])
    for i in range(len(nodes)):
        graph.add(i)
    return pickle.dumps((graph, nodes[mix], starts[:-1][mix], starts[1:][mix], ids), protocol=5)


def search_graph(made: tuple, query_ids: np.ndarray, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> pd.DataFrame:
    graph, nodes, first, after, ids = made
    out: list[tuple[int, int, float]] = []
    for qid, q in zip(query_ids.tolist(), queries, strict=True):
        hit = graph.search(q, max(width, k + 1))
        exact = np.sqrt(((nodes[hit] - q) ** 2).sum(axis=1))
        best: dict[int, float] = {}
        for d, v in sorted((d, v) for d, h in zip(exact.tolist(), hit.tolist(), strict=True) for v in ids[first[h] : min(after[h], first[h] + k + 1)].tolist()):
            if v != qid and len(best) < k:
                best.setdefault(v, d)
        out += [(qid, v, d) for v, d in best.items()]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, query_filter, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 4096) -> DataFrame:
    """Each query's k nearest found by Euclidean distance: query_id, rank, vec_id, score.

    Vectors null, empty, zero, or with null or non-finite components, and rows without an id, take no part; vectors are
    compared with those of their own length. Rows that repeat with id and vector are one candidate; an id with several
    vectors is one with the nearest of them, and asks with each. No rows give none.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()
    queries = rows.where(query_filter(F.col("id")))
    return scatter_search(rows, queries, build_graph, search_graph, k, "double", True, shard_rows)
