"""A training-data pipeline over ``documents``: quality, near-duplicates, secrets, source mixing, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, pieces, quality, secrets
from tidemark.llm.common import identity, shared_path
from tidemark.llm.queries import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 in shingles of five words, found by SimHash prints and, where
    these are too far apart, MinHash bands, one row: that with the least id (nulls last), then the least digest of id and text."""
    key = F.unhex(identity(["doc_id", "text"]))
    classes = minhash.near_copies(docs, key)
    kept = classes.groupBy("root", "twin").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("k")).select(F.col("k.key").alias("__key"))
    # One exchange of the texts: joined and made distinct by the same key.
    return docs.select(*COLUMNS, key.alias("__key")).join(kept, "__key").dropDuplicates(["__key"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark."""
    clean = secrets.redact(secrets.find_secrets(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the sources' target weights, in a global random order."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, and whether they decode to its text."""
    return pieces.encode_pieces(docs, PIECE_MODEL).select("doc_id", "lang", "source", "n_chars", "n_ids", "ids", "decoded_equal")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Compression, fingerprints and merges aren't SQL; near duplicates, redaction, mixing and pieces are tested against plain Python,
#: in tests/llm; quality as a stage only by its counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    path = shared_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
