"""SimHash near-duplicates: fingerprints, pigeonhole block join, verified Hamming links, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import connected_components
from tidemark.runtime import ship

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def majority(hashes: np.ndarray) -> int:
    """The print of 64-bit hashes: each bit that is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; 0 where there are no words."""
    if not text:
        return 0
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    words = _WORD.findall(raw)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), "<u8", len(starts)))


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """Column of fingerprints as signed longs (the same 64 bits)."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([simhash(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def block_masks(blocks: int, bits: int) -> list[int]:
    """Masks of every choice of ``blocks - bits`` blocks: prints at most ``bits`` apart agree on at least one mask."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(rows: int, bits: int) -> int:
    """The fewest blocks whose keys are at least as long as the count, so buckets hold about one chance neighbour."""
    return next((b for b in range(bits + 2, 4 * bits + 5) if 64 * (b - bits) / b >= np.log2(max(rows, 2)) + 1), 4 * bits + 4)


def spanning_links(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the prints of one bucket: what is linked in the bucket is connected by them."""
    out, rest = [], prints
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                hit = rest[near]
                out += [(x, y) for y in hit]
                todo += list(hit)
                rest = rest[~near]
    return out


def _bucket_links(bits: int, small: int = 24):
    """mapInPandas over rows sorted by bucket: small buckets by shifted comparison of all at once, others one by one."""

    def links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        cut_at = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.concatenate(([0], cut_at))
        size = np.diff(np.concatenate((first, [len(key)])))
        us, vs = [], []
        for a, n in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
            for x, y in spanning_links(fp[a : a + n], bits):
                us.append([x])
                vs.append([y])
        keep = np.repeat((size <= small) & (size > 1), size)
        k, f, left = key[keep], fp[keep], np.repeat(np.where(size <= small, size, 0), size)[keep]
        for shift in range(1, int(left.max(initial=1))):
            i = np.flatnonzero(k[shift:] == k[:-shift])
            i = i[np.bitwise_count(f[i] ^ f[i + shift]) <= bits]
            us.append(f[i])
            vs.append(f[i + shift])
        u, v = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (us, vs))
        return pd.DataFrame({"u": u.astype(np.uint64).view(np.int64), "v": v.astype(np.uint64).view(np.int64)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for pdf in batches:
            if not len(pdf):
                continue
            key = np.concatenate((key, pdf["k"].to_numpy(np.int64)))
            fp = np.concatenate((fp, pdf["fp"].to_numpy(np.int64).view(np.uint64)))
            end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if end:
                yield links(key[:end], fp[:end])
                key, fp = key[end:], fp[end:]
        if len(key):
            yield links(key, fp)

    return run


def near_links(prints: DataFrame, bits: int = 4, blocks: int | None = None, bucket_rows: int = 20_000) -> DataFrame:
    """Distinct prints (fp long) to links (u, v), verified to differ in at most ``bits`` bits and enough to connect all that are linked.

    Buckets of over ``bucket_rows`` prints are dealt in pairs of slices, so none is too large for a task.
    """
    blocks = blocks or choose_blocks(prints.count(), bits)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(blocks, bits))])
    keyed = prints.select("fp", F.explode(keys).alias("k"))
    large = cut(keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows))
    if not large.isEmpty():
        sliced = keyed.join(large, "k", "left").withColumn("c", F.ceil(F.coalesce("n", F.lit(1)) / bucket_rows))
        own = F.pmod(F.xxhash64("fp"), F.col("c"))
        other = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda j: F.xxhash64("k", F.least(own, j), F.greatest(own, j))))
        keyed = sliced.select("fp", other.alias("k"))
    dealt = keyed.repartition("k").sortWithinPartitions("k", "fp")
    return dealt.mapInPandas(_bucket_links(bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, seed: int = 42, blocks: int | None = None, row_key: Column | None = None) -> DataFrame:
    """One row (id, fp, root, component_id) per row of ``docs``; component_id is the least id reachable over links.

    root is a print that names the class. With ``row_key``, that column goes along as key.

    Null and empty texts and texts of white space have print 0 and are linked as any others; repeated rows come back
    as often as they came; a null id gets its class's least id, null only where the class has no other. No rows give none.
    """
    ship(docs.sparkSession)
    own = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle, seed).alias("fp"), *([] if row_key is None else [row_key.alias("key")])))
    least = own.groupBy("fp").agg(F.min("id").alias("low"))
    least = cut(least)
    roots = connected_components(near_links(least.select("fp"), bits, blocks))
    classed = cut(least.join(roots, least.fp == roots.node, "left").select("fp", "low", "root"))
    linked = classed.where(F.col("root").isNotNull())
    # Cut off, so the join back is not done where the minima were gathered, and a giant class may be split over tasks.
    lowest = cut(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    alone = classed.where(F.col("root").isNull()).select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    members = alone.unionByName(linked.join(lowest, "root").select("fp", "root", "component_id"))
    return own.join(members, "fp").select("id", "fp", "root", "component_id", *([] if row_key is None else ["key"]))
