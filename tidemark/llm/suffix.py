"""Exact removal of repeated byte strings with a sparse, distributed suffix sort.

A string of ``length`` bytes that occurs twice holds the same window minimum (an anchor) at the same place both times, so
only the suffixes at anchors need sorting. Anchors whose k-gram occurs once are dropped first. The rest are sorted in
runs, the runs are front-coded and exchanged by ranges of the order, and a loser tree merges them without comparing
known prefixes again. Along the sorted suffixes, common prefixes on the right are joined with common suffixes on the left.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, row_key
from tidemark.runtime import ship

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_BLOCK, _BITS = 1 << 18, np.uint64(21)
#: Documents handled at once, and bytes of suffixes that a task holds before it writes them out as runs.
_ROWS, _HELD = 256, 16_000_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[size] = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (_BASE, inverse))
    p, q = _POWERS[size]
    return p[:n], q[:n]


def kgram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit polynomial hash of each k bytes."""
    p, q = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)))
    h = (sums[k:] - sums[:-k]) * q[: len(raw) - k + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w values in a row, from block prefixes and suffixes."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the leftmost least k-gram of every window of ``length`` bytes."""
    data, at, hashes = np.frombuffer(raw, np.uint8), [], []
    for a in range(0, len(raw) - length + 1, _BLOCK):
        h = kgram_hashes(data[a : a + _BLOCK + length - 1], k)
        key = (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)
        found = np.unique(sliding_min(key, length - k + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        at.append(found + a)
        hashes.append(h[found])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pos, first = np.unique(np.concatenate(at), return_index=True)
    h = np.concatenate(hashes)[first] * _MIX
    return pos, h ^ (h >> np.uint64(31))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _context(raw: bytes, pos: int, length: int, k: int) -> tuple[bytes, bytes]:
    """All that a repeated string at an anchor can hold on its right and, reversed, on its left."""
    return raw[pos : pos + length], raw[max(0, pos - length + k) : pos][::-1]


def grouped_anchors(raw: bytes, length: int, k: int) -> list[tuple[int, list[int]]]:
    """(k-gram hash as signed long, positions) of a text's anchors; anchors of equal context are one row."""
    pos, h = anchors(raw, length, k)
    hashes, count = np.unique(h, return_counts=True)
    if len(hashes) == len(h):
        return list(zip(h.view(np.int64).tolist(), pos[:, None].tolist(), strict=True))
    often, out = set(hashes[count > 1].view(np.int64).tolist()), {}
    for x, p in zip(h.view(np.int64).tolist(), pos.tolist(), strict=True):
        out.setdefault((x, *_context(raw, p, length, k)) if x in often else p, (x, []))[1].append(p)
    return list(out.values())


def _find_anchors(length: int, k: int):
    """mapInArrow: documents (k1, k2, text) to their anchors (k1, k2, h, ps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                k1, k2, texts = (c.slice(at, _ROWS) for c in whole.columns)
                found = [grouped_anchors(_raw(t.as_py()), length, k) for t in texts]
                n = [len(x) for x in found]
                if sum(n):
                    keys = [pa.array(np.repeat(c.to_numpy(), n)) for c in (k1, k2)]
                    rest = [pa.array([h for x in found for h, _ in x], pa.int64()), pa.array([ps for x in found for _, ps in x], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*keys, *rest], names=["k1", "k2", "h", "ps"])

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def encode_run(rows: list[tuple]) -> bytes:
    """Front-code sorted rows (suffix, left, owners) as one run."""
    shared, rest, before = [], [], b""
    for suffix, _, _ in rows:
        shared.append(n := common_prefix(before, suffix))
        rest.append(suffix[n:])
        before = suffix
    return pickle.dumps((shared, rest, [r[1] for r in rows], [r[2] for r in rows]), protocol=5)


def decode_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes, list]]:
    """Rows (prefix shared with the one before, suffix, left, owners)."""
    before = b""
    for n, rest, left, owners in zip(*pickle.loads(blob), strict=True):
        before = before[:n] + rest
        yield n, before, left, owners


def merge_runs(blobs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, list]]:
    """Merge front-coded runs with a loser tree; rows come with the prefix shared with the row before.

    Every candidate knows its common prefix with the last row out. Of two candidates the one that shares more is the
    lesser; only where both share the same are bytes compared, and only from there on.
    """
    runs = [decode_run(b) for b in blobs]
    size = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; the loser's known prefix is then that with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        s, t = x[1], y[1]
        n = common_prefix(s, t, shared[a])
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    tree, level, losers = [0] * size, list(range(size)), [0] * size
    width = size
    while width > 1:
        won = []
        for i in range(0, width, 2):
            w, lost = play(level[i], level[i + 1])
            losers[width // 2 + i // 2] = lost
            won.append(w)
        level, width = won, width // 2
    tree[0] = best = level[0]
    while (row := heads[best]) is not None:
        yield shared[best], row[1], row[2], row[3]
        heads[best] = follow = next(runs[best], None)
        shared[best] = follow[0] if follow else 0
        node, now = (size + best) // 2, best
        while node:
            now, losers[node] = play(now, losers[node])
            node //= 2
        best = now


def longest_repeats(shared: list[int], lefts: list[bytes], rights: list[int], length: int) -> list[tuple[int, int] | None]:
    """For suffixes in order, the most that a repeated string of ``length`` reaches to the left and to the right of each anchor.

    ``shared[i]`` is the prefix shared with suffix i - 1; ``lefts`` hold what stands left of the anchors, reversed. Suffixes
    are joined in falling order of their shared prefix, the smaller class into the larger. In the larger, kept in the
    order of the left sides, only the two neighbours count: whatever lies beyond them shares no more on either side.
    """
    n = len(lefts)
    best: list[list[int] | None] = [None] * n

    def meet(i: int, j: int, right: int) -> None:
        left = common_prefix(lefts[i], lefts[j])
        if left + right >= length:
            for x in (i, j):
                b = best[x]
                if b is None:
                    best[x] = [left, right]
                else:
                    b[0], b[1] = max(b[0], left), max(b[1], right)

    if n == 2:
        meet(0, 1, shared[1])
        return best
    rank = {i: r for r, i in enumerate(sorted(range(n), key=lambda i: lefts[i]))}
    by_rank = {r: i for i, r in rank.items()}
    of, classes = list(range(n)), {i: [rank[i]] for i in range(n)}

    def find(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i in sorted(range(1, n), key=lambda i: -shared[i]):
        a, b = find(i - 1), find(i)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        big = classes[a]
        for r in classes.pop(b):
            at = bisect_left(big, r)
            for other in big[max(0, at - 1) : at + 1]:
                meet(by_rank[r], by_rank[other], shared[i])
            big.insert(at, r)
        of[b] = a
    return best


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _places(whole: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int, bytes, list[tuple[list[int], int, int]]]]:
    """Rows (k1, k2, bytes, [(positions, h, n)]) of documents with their anchors."""
    k1, k2, texts, found = (_column(whole, n) for n in ("__k1", "__k2", text_col, "__found"))
    for row in range(whole.num_rows):
        yield k1[row].as_py(), k2[row].as_py(), _raw(texts[row].as_py()), [(x["ps"], x["h"], x["n"]) for x in found[row].as_py()]


def _merged(ps: list[int], left: int, right: int) -> list[tuple[int, int]]:
    """Spans around positions in rising order, those that touch made one."""
    out: list[list[int]] = []
    for p in sorted(ps):
        if out and p - left <= out[-1][1]:
            out[-1][1] = p + right
        else:
            out.append([p - left, p + right])
    return [(a, b) for a, b in out]


def _digest_contexts(text_col: str, length: int, k: int):
    """mapInArrow: anchors to a digest of all that a repeated string at the anchor can hold, and to two finer group keys.

    Two anchors of one repeated string share half of ``length`` on the right or on the left.
    """
    half = length // 2
    short = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = []
            for k1, k2, raw, found in _places(whole, text_col):
                for ps, h, _ in found:
                    (right, left), key = _context(raw, ps[0], length, k), (h & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
                    ctx = hashlib.blake2b(key + len(left).to_bytes(4, "big") + left + right, digest_size=16).digest()
                    groups = [short(b"R" + key + right[:half])] * (len(right) >= half) + [short(b"L" + key + left[:half])] * (len(left) >= half)
                    rows.append((k1, k2, ps, ctx, groups, len(left), len(right)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k1", "k2", "ps", "ctx", "gs", "l", "r"])

    return run


def _write_runs(text_col: str, length: int, k: int, ranges: int, hot_rows: int):
    """mapInArrow: documents with their anchors to front-coded runs (part, run) of the suffixes at those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [encode_run(sorted(((s, left, o) for (s, left), o in got.items()), key=lambda r: r[0])) for got in parts.values()]
            made = pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(rows, pa.binary())], names=["part", "run"])
            parts.clear()
            return made

        for whole in batches:
            for k1, k2, raw, found in _places(whole, text_col):
                for ps, h, n in found:
                    h &= 0xFFFFFFFFFFFFFFFF
                    right, left = _context(raw, ps[0], length, k)
                    suffix = h.to_bytes(8, "big") + right
                    where = [(h * ranges) >> 64]
                    if n > hot_rows:
                        slices = -(-n // hot_rows)
                        own = hash((k1, k2, ps[0])) % slices
                        where = [hash((h, min(own, j), max(own, j))) % (1 << 40) + ranges for j in range(slices)]
                    for part in where:
                        parts.setdefault(part, {}).setdefault((suffix, left), []).append((k1, k2, ps))
                    held += len(suffix) + len(left)
                if held > _HELD:
                    yield out()
                    held = 0
        if parts:
            yield out()

    return run


def _merge_part(length: int, k: int):
    """applyInPandas: the runs of one range to repeated spans (k1, k2, start, end)."""

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        shared: list[int] = []
        rows: list[tuple[bytes, bytes, list]] = []

        def close() -> None:
            whole = [(len(left), len(s) - 8) if len(o) + len(o[0][2]) > 2 and len(left) + len(s) - 8 >= length else None for s, left, o in rows]
            near = longest_repeats([max(0, n - 8) for n in shared], [r[1] for r in rows], [len(r[0]) - 8 for r in rows], length) if len(rows) > 1 else [None]
            for (_, _, owners), w, b in zip(rows, whole, near, strict=True):
                if hit := w or b:
                    out.extend((k1, k2, a, b) for k1, k2, ps in owners for a, b in _merged(ps, *hit))

        for n, s, left, owners in merge_runs(list(pdf["run"])):
            if n < 8 + k and rows:
                close()
                rows, shared = [], []
            rows.append((s, left, owners))
            shared.append(n)
        if rows:
            close()
        return pd.DataFrame(out, columns=["k1", "k2", "start", "end"], dtype=np.int64)

    return spans


def merge_spans(spans: Column) -> Column:
    """Sorted array of (start, end) with those that overlap or touch made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), step)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, kgram: int = 32, range_rows: int = 8000, hot_rows: int = 2000) -> DataFrame:
    """``docs`` with ``spans``: the maximal byte runs (start, end) of each UTF-8 text covered by repeated strings of ``length``.

    A string repeats if it also starts anywhere else, in the same text or another; overlaps count. Null and short texts
    have no spans; rows that repeat with id and text are documents of their own, so long ones are covered whole. Anchors
    whose k-gram is in over ``hot_rows`` places are first matched by digests of all around them; those that differ are
    grouped by half a string on either side, and groups still above ``hot_rows`` are dealt in pairs of slices. So no range
    holds an unbounded group, and none is left out.
    A column named spans is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("spans")
    whole = docs.withColumns({"__k1": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), "__k2": row_key(F.col(id_col), F.col(text_col))})
    keys = ["__k1", "__k2"]
    # Kept until both the counts and the rows kept are checkpointed, as finding anchors is the dearest step; lost blocks are found anew.
    found = whole.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text_col).alias("text")).mapInArrow(_find_anchors(length, kgram), "k1 long, k2 long, h long, ps array<long>")
    found = found.persist(StorageLevel.DISK_ONLY)
    often = cut(found.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.size("ps")).alias("places")).where("places > 1").drop("places"))
    wanted = cut(found.join(often, "h").select("k1", "k2", "ps", "h", "n"))
    found.unpersist()

    def placed(rows: DataFrame) -> DataFrame:
        # All columns go along: so both uses, and the last join, share one exchange of the texts.
        lists = rows.groupBy("k1", "k2").agg(F.collect_set(F.struct("ps", "h", "n")).alias("__found"))
        return whole.join(lists.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), keys)

    hot, direct = wanted.where(F.col("n") > hot_rows), None
    if not hot.isEmpty():
        digests = cut(placed(hot).mapInArrow(_digest_contexts(text_col, length, kgram), "k1 long, k2 long, ps array<long>, ctx binary, gs array<long>, l long, r long"))
        one = cut(digests.groupBy("ctx").agg(F.sum(F.size("ps")).alias("c"), F.min(F.struct("k1", "k2", "ps")).alias("o"), F.min("gs").alias("gs"), F.min(F.col("l") + F.col("r")).alias("size")))
        same = one.where((F.col("c") > 1) & (F.col("size") >= length)).select("ctx")
        around = F.transform(F.sort_array("ps"), lambda p: F.struct((p - F.col("l")).alias("start"), (p + F.col("r")).alias("end")))
        direct = digests.join(same, "ctx").select("k1", "k2", F.explode(merge_spans(around)).alias("s")).select("k1", "k2", "s.*")
        grouped = one.select("o.*", F.explode("gs").alias("h"))
        shared = cut(grouped.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        wanted = cut(wanted.where(F.col("n") <= hot_rows).unionByName(grouped.join(shared, "h").select("k1", "k2", "ps", "h", "n")))
    ranges = max(1, wanted.count() // range_rows)
    runs = placed(wanted).mapInArrow(_write_runs(text_col, length, kgram, ranges, hot_rows), "part long, run binary")
    spans = runs.groupBy("part").applyInPandas(_merge_part(length, kgram), "k1 long, k2 long, start long, end long")
    spans = spans if direct is None else spans.unionByName(direct)
    gathered = spans.distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    gathered = gathered.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), merge_spans(F.col("spans")).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return whole.join(gathered, keys, "left").withColumn("spans", F.coalesce("spans", none)).drop(*keys)


def kept_digest(text: Column, spans: Column) -> Column:
    """Struct of n_bytes, n_removed, n_spans, kept_sha256, n_kept and kept: sizes, digest and text of what is left without the spans.

    Spans may cut a character: then ``kept`` has replacement characters, the digest the bytes as they are.
    """

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept string")
    def digests(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, cuts, strict=True):
            raw = _raw(text)
            parts, at = [], 0
            for s in found:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            left = b"".join([*parts, raw[at:]])
            rows.append((len(raw), len(raw) - len(left), len(found), hashlib.sha256(left).hexdigest(), len(left), left.decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept"])

    return digests(text, spans)
