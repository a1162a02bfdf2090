"""The pipeline's near-duplicate stage against brute force over shingles of five words."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import minhash

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def classes(rows):
    sets, root, having = [shingles(t) for _, t in rows], list(range(len(rows))), {}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, s in enumerate(sets):
        for j in {j for x in s for j in having.get(x, ())}:
            if 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                root[find(i)] = find(j)
        for x in s:
            having.setdefault(x, []).append(i)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(c) for c in out.values())


def planted():
    """Texts of 200 words and edited copies of them, at similarities about 0.8."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((1000 * i, " ".join(ws)))
        for k in range(1, 4):
            edited = list(ws)
            for at in rng.sample(range(5, 195), k + 2):
                edited[at] = f"e{rng.randrange(10**6)}"
            rows.append((1000 * i + k, " ".join(edited)))
    return rows + [(10**6 + k, t) for k, t in enumerate([None, "", " \n", "a b", "A  B", "a b c"])]


@pytest.mark.parametrize("which", ["planted", "documents"])
def test_stage_keeps_one_of_each_class(spark, which):
    rows = planted() if which == "planted" else [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(c[0] for c in classes(rows))


def test_classes_do_not_depend_on_slices(spark):
    rows = planted()[:400]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {}
    for r in minhash.near_copies(docs, F.xxhash64("doc_id", "text"), slice_rows=2).collect():
        got.setdefault((r.root, r.twin), []).append(r.id)
    assert sorted(sorted(c) for c in got.values()) == classes(rows)


def test_prints_find_close_copies_without_bands(spark):
    rng = random.Random(8)
    rows = []
    for i in range(0, 60, 2):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows.append((i, " ".join(ws)))
        rows.append((i + 1, " ".join([*ws[:1000], "other", *ws[1001:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    # One band of 4,000 rows, which sets that differ practically never share.
    for r in minhash.near_copies(docs, F.xxhash64("doc_id", "text"), bands=1, rows=4000).collect():
        got.setdefault((r.root, r.twin), []).append(r.id)
    assert sorted(sorted(c) for c in got.values()) == classes(rows) == [[i, i + 1] for i in range(0, 60, 2)]


def test_similarity_is_held_exactly():
    a = np.arange(9, dtype=np.uint64)
    assert minhash.spanning_links([a[:8], a[1:9]], 0.8) == []  # 7 of 9
    assert minhash.spanning_links([np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64)], 0.8) == [(0, 1)]


def test_last_stage_marks_what_does_not_round_trip(spark):
    docs = spark.createDataFrame([(1, "plain words", "en", "s", 11), (2, "odd ▁ mark", "en", "s", 10)], SCHEMA)
    assert {r.doc_id: r.decoded_equal for r in corpus_pipeline.encode(spark, docs, SF).collect()} == {1: True, 2: False}
