"""Quality classifier: Zstandard dictionaries of good and bad texts; the normalised difference of sizes is calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import ship

#: Bounds of what the driver fits on: texts of each label and bytes of a text (so 144 MB in all), bytes of each dictionary; and a window's bytes.
FIT_TEXTS, FIT_TEXT_BYTES, DICTIONARY_BYTES, WINDOW = 3000, 24_000, 1 << 19, 1024
#: Bytes that a frame takes for itself, left out of the rates.
FRAME_BYTES = 9


@dataclass
class CompressionModel:
    """Two dictionaries and the calibration: weights of the standardised terms, the constant last."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    level: int = 3

    def coders(self) -> tuple[zstandard.ZstdCompressor, ...]:
        made = []
        for raw in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)

    def scores(self, measures: np.ndarray) -> np.ndarray:
        """Calibrated scores of rows of size_measures; a half for texts of no bytes."""
        z = (terms(measures) - self.mean) / self.spread
        # Summed row by row: a matrix product may round a row by its place, and copies are to score alike.
        p = 1 / (1 + np.exp(-np.clip((z * self.weights[:-1]).sum(axis=1) + self.weights[-1], -700, 700)))
        return np.where(measures[:, 3] == 0, 0.5, p)


def size_measures(text: str | None, coders: tuple) -> tuple[float, float, float, float]:
    """Over windows of the whole text: (size with bad - size with good) / their sum, the two sizes per byte, and 1 / sqrt(bytes)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0, 0.0, 0.0, 0.0
    good = bad = frames = 0
    for a in range(0, len(raw), WINDOW):
        part = raw[a : a + WINDOW]
        good += len(coders[0].compress(part))
        bad += len(coders[1].compress(part))
        frames += 1
    return (bad - good) / (bad + good), (good - FRAME_BYTES * frames) / len(raw), (bad - FRAME_BYTES * frames) / len(raw), len(raw) ** -0.5


def terms(m: np.ndarray) -> np.ndarray:
    """What the calibration weighs: the difference, both rates, their squares and products, and the difference by length."""
    d, g, b, s = m.T
    return np.column_stack([d, g, b, d * d, g * g, b * b, g * b, d * s, s])


def _dictionary(texts: list[bytes]) -> bytes:
    """Pieces of the texts in turn, so that each text gives its share."""
    parts, total, at = [], 0, 0
    while total < DICTIONARY_BYTES and any(at < len(t) for t in texts):
        for t in texts:
            if at < len(t) and total < DICTIONARY_BYTES:
                parts.append(t[at : at + 256])
                total += len(parts[-1])
        at += 256
    return b" ".join(parts)[:DICTIONARY_BYTES]


def fit_model(rows: list[tuple[str | None, int]]) -> CompressionModel:
    """Fit on (text, label). Half the texts make the dictionaries, the other half calibrates a logistic curve.

    Both labels weigh the same. With no text of one label, every score is the share of label 1 with a pseudo-count each.
    """
    kinds = {y: [t.encode("utf-8", "surrogatepass") for t, label in rows if label == y and t] for y in (0, 1)}
    n1, n0 = len(kinds[1]), len(kinds[0])
    width = len(terms(np.zeros((1, 4)))[0])
    constant = np.append(np.zeros(width), np.log((n1 + 1) / (n0 + 1)))
    model = CompressionModel(_dictionary(kinds[1][::2]), _dictionary(kinds[0][::2]), np.zeros(width), np.ones(width), constant)
    if not n1 or not n0:
        return model
    coders = model.coders()
    held = [(size_measures(t.decode("utf-8", "surrogatepass"), coders), y) for y in (0, 1) for t in (kinds[y][1::2] or kinds[y])]
    x, y = terms(np.array([h[0] for h in held])), np.array([float(h[1]) for h in held])
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - model.mean) / model.spread, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, ridge = np.zeros(width + 1), 1e-4
    for _ in range(100):  # Newton steps on the weighted logistic loss
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(width + 1)
        step = np.linalg.solve(hess, z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w
    return model


def held_out(doc_id: Column, remainder: int = 2, folds: int = 4) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_TEXTS) -> list[tuple[str | None, int]]:
    """Texts and labels of at most ``most`` rows of each label outside the held-out fold, those whose ids hash lowest.

    Only their ids and labels reach the sort; texts over FIT_TEXT_BYTES aren't used for fitting, and of several texts of one id
    the least is, so the fit is the same each time.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = None
    for y in (0, 1):
        part = usable.where(F.col(label_col) == y).select(F.col(id_col).alias("__id"), F.lit(y).alias("__y")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.octet_length("t") <= FIT_TEXT_BYTES)
    rows = texts.join(F.broadcast(picked), F.col("i") == F.col("__id")).groupBy("i", F.col("__y").alias("y")).agg(F.min("t").alias("t")).collect()
    return [(r.t, r.y) for r in sorted(rows, key=lambda r: (r.i, r.y))]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``threshold``, else 0).

    The score follows the text alone: copies score alike, null and empty texts score a half.
    Every window of a text counts, whatever its length. Columns of these names are replaced; no rows give none.
    """
    ship(docs.sparkSession)
    model = fit_model(labelled_sample(docs, labels, id_col=id_col, text_col=text_col))

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders = model.coders() if model.good and model.bad else None
        for texts in batches:
            m = [size_measures(t, coders) if coders else (0.0, 0.0, 0.0, 1.0 if t else 0.0) for t in (x.as_py() for x in texts)]
            yield pa.array(model.scores(np.array(m).reshape(-1, 4)))

    scored = docs.drop("score", "predicted").withColumn("score", scores(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
