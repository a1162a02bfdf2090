"""Near copies by shingle similarity: SimHash prints, and MinHash bands for what they miss, for candidates; exact Jaccard similarity for links; components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import majority, near_links
from tidemark.runtime import ship

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words where there are fewer, so never empty."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found] or [1]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(shingles: np.ndarray, bands: int, rows: int, seed: int = 42) -> np.ndarray:
    """A key per band, which two sets of similarity s share with a chance of s to the power of ``rows``."""
    a, b = np.random.default_rng(seed).integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    low = np.full(bands * rows, ~np.uint64(0))
    for i in range(0, len(shingles), 512):
        low = np.minimum(low, ((shingles[i : i + 512] ^ b) * (a | np.uint64(1))).min(axis=1))
    low, keys = low.reshape(bands, rows), np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = (keys ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def sketch(text: Column, words: int, bands: int, rows: int) -> Column:
    """Column of (sid, twin, fp, keys): two hashes of the shingle set, equal for equal sets, its SimHash print and its band keys."""

    @F.arrow_udf("struct<sid:long,twin:long,fp:long,keys:array<long>>")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingle_set(t.as_py(), words) for t in texts]
            sid, twin = (pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)) for seed in (0, 1))
            fp = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            keys = np.array([band_keys(s, bands, rows) for s in sets], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), pa.array(keys))
            yield pa.StructArray.from_arrays([sid, twin, fp, lists], ["sid", "twin", "fp", "keys"])

    return sketches(text)


def spanning_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest over sets of a similarity of at least ``similarity``, which is held exactly."""
    least = Fraction(str(similarity))
    size = np.array([len(s) for s in sets])
    off = np.concatenate(([0], np.cumsum(size)))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(code))))
    rest, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        todo = [seed] if rest[seed] else []
        rest[seed] = False
        while todo:
            x = todo.pop()
            c = code[off[x] : off[x + 1]]
            n = first[c + 1] - first[c]
            at = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero(rest & (common * least.denominator >= (size + size[x] - common) * least.numerator))
            rest[near] = False
            out += [(x, y) for y in near.tolist()]
            todo += near.tolist()
    return out


def _group_links(words: int, similarity: float):
    """mapInPandas over rows (g, sid, text) sorted by g: links within each g."""

    def links(sids: list[int], texts: list[str | None]) -> pd.DataFrame:
        each = dict(zip(sids, texts, strict=True))
        ids = list(each)
        found = spanning_links([shingle_set(t, words) for t in each.values()], similarity)
        return pd.DataFrame({"u": [ids[x] for x, _ in found], "v": [ids[y] for _, y in found]}, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, sids, texts = None, [], []
        for pdf in batches:
            for key, sid, text in zip(pdf["g"].tolist(), pdf["sid"].tolist(), pdf["text"].tolist(), strict=True):
                if key != g:
                    if len(sids) > 1:
                        yield links(sids, texts)
                    g, sids, texts = key, [], []
                sids.append(sid)
                texts.append(text)
        if len(sids) > 1:
            yield links(sids, texts)

    return run


def near_copies(docs: DataFrame, row_key: Column, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 40, rows: int = 7, slice_rows: int = 1000, slice_chars: int = 4_000_000, bits: int = 4) -> DataFrame:
    """One row (id, key, root, twin) per row of ``docs``; root and twin name its class, the rows connected by similarities of at least ``similarity``.

    twin is a second hash of the shingles where a row has no links to other sets, else 0: so only 128 bits in common make
    unlinked rows one class. ``row_key`` should be as long.

    Sets whose SimHash prints differ in at most ``bits`` bits are candidates. Most pairs near 0.8 are further apart, so sets
    that share a band key are too, which a pair just at 0.8 fails to do with a chance of 8e-5. Each group of
    connected candidates is compared exactly; groups of over ``slice_rows`` sets or ``slice_chars`` characters are dealt in
    pairs of slices, so none is too large for a task. Null and empty texts and texts of white space are copies of each other.
    """
    ship(docs.sparkSession)
    body = F.col(text_col)
    own = cut(docs.select(F.col(id_col).alias("id"), row_key.alias("key"), F.coalesce(F.length(body), F.lit(0)).alias("chars"), sketch(body, words, bands, rows).alias("s")).select("id", "key", "chars", "s.*"))
    prints = cut(own.groupBy("fp").agg(F.min("sid").alias("m")))
    close = near_links(prints.select("fp"), bits)
    for end in ("u", "v"):  # prints to a set of each
        close = close.join(prints.select(F.col("fp").alias(end), F.col("m").alias(f"set_{end}")), end)
    # A print is a key as well: equal ones are no link between prints.
    every = F.explode(F.concat("keys", F.array(F.xxhash64(F.lit("print"), "fp"))))
    keyed = own.select("sid", "fp", "keys").dropDuplicates(["sid"]).select("sid", every.alias("k"))
    low = keyed.groupBy("k").agg(F.min("sid").alias("m"), F.count("*").alias("n")).where("n > 1").select("k", "m")
    banded = keyed.join(low, "k").where("sid <> m").select(F.col("m").alias("u"), F.col("sid").alias("v"))
    groups = connected_components(banded.unionByName(close.select(F.col("set_u").alias("u"), F.col("set_v").alias("v"))))
    # A text for each set: of the rows that have it, that of the least key.
    one = cut(own.groupBy("sid").agg(F.min(F.struct("key", "chars")).alias("o")).join(groups, F.col("sid") == F.col("node")).select("sid", "root", "o.*"))
    # Cut off, so the join back is not done where the sizes were summed, and a giant group may be split over tasks.
    sizes = cut(one.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / slice_rows, F.sum("chars") / slice_chars, F.lit(1.0))).alias("c")))
    dealt = one.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("c")))
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda j: F.xxhash64("root", F.least("own", j), F.greatest("own", j)))
    texts = docs.select(row_key.alias("key"), body.alias("text")).join(dealt.select("key", "sid", other.alias("gs")), "key").dropDuplicates(["key"])
    pairs = texts.select(F.explode("gs").alias("g"), "sid", "text").repartition("g").sortWithinPartitions("g", "sid")
    roots = connected_components(pairs.mapInPandas(_group_links(words, similarity), "u long, v long"))
    twin = F.when(F.col("root").isNull(), F.col("twin")).otherwise(F.lit(0).cast("long"))
    return own.join(roots, own.sid == roots.node, "left").select("id", "key", F.coalesce("root", "sid").alias("root"), twin.alias("twin"))
