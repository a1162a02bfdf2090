"""The quality score against a scorer of its own: plain compression sizes, and a logistic curve fitted by descent."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import quality

SF = "/root/testdata/sf0.01"


def test_scores_equal_an_independent_scorer(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] is not None}
    fit = sorted(i for i, y in labels.items() if y in (0, 1) and i in docs and zlib.crc32(str(i).encode()) % 4 != 2 and 0 < len(docs[i].encode()) <= 24_000)
    raw = {y: [docs[i].encode() for i in fit if labels[i] == y] for y in (0, 1)}

    def pieces(texts):
        out, a = [], 0
        while any(a < len(t) for t in texts) and sum(map(len, out)) < 1 << 19:
            out += [t[a : a + 256] for t in texts if a < len(t)]
            a += 256
        return b" ".join(out)

    def coder(texts):
        whole = pieces(texts)
        assert len(whole) < 1 << 19
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    good, bad = coder(raw[1][::2]), coder(raw[0][::2])

    def row(t):
        parts = [t[a : a + 1024] for a in range(0, len(t), 1024)]
        g, b = (sum(len(c.compress(p)) for p in parts) for c in (good, bad))
        d, rg, rb, s = (b - g) / (b + g), (g - 9 * len(parts)) / len(t), (b - 9 * len(parts)) / len(t), 1 / np.sqrt(len(t))
        return [d, rg, rb, d * d, rg * rg, rb * rb, rg * rb, d * s, s]

    x = np.array([row(t) for y in (0, 1) for t in raw[y][1::2]])
    y = np.array([float(v) for v in (0, 1) for _ in raw[v][1::2]])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(z.shape[1])
    for _ in range(500):  # damped Newton steps
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(len(w))
        w -= 0.5 * np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-4 * w)
    got = {r.doc_id: r.score for r in quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "score").collect()}
    for i, t in docs.items():
        want = 1 / (1 + np.exp(-(np.append((np.array(row(t.encode())) - mean) / spread, 1) @ w))) if t else 0.5
        assert abs(got[i] - want) < 1e-6


def test_fit_does_not_hang_on_the_order_of_rows(spark):
    rows = [(i % 40, f"{'good words here' if i % 2 else 'bad junk there'} {i}" * 5) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = quality.labelled_sample(docs.repartition(7), labels)
    assert one == quality.labelled_sample(docs.orderBy(F.col("text").desc()), labels) and len(one) <= 40
