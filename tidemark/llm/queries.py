"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import hnsw, mixing, mtree, pieces, quality, secrets, sharding, simhash, suffix, warc
from tidemark.llm.common import shared_path

#: The vocabulary file of op3; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every_hundredth(vec_id):
    return F.pmod(vec_id, F.lit(100)) == 0


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), _every_hundredth)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    digest = F.sha2(secrets.joined_spans(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest.alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL).select("doc_id", "n_ids", "ids", "decoded_equal")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = spans.select("doc_id", suffix.kept_digest(F.col("text"), F.col("spans")).alias("d"))
    return told.select("doc_id", "d.n_bytes", "d.n_removed", "d.n_spans", "d.kept_sha256", "d.n_kept", F.col("d.kept").alias("text"))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(_table(spark, sf_dir, "embeddings"), _every_hundredth)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.length("text").alias("text_chars"), "copy", "copies", F.round("rate", 9).alias("rate"), "mix_order")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(sharding.shard_records(_table(spark, sf_dir, "documents")))
    body = F.coalesce(F.col("text"), F.lit(""))
    return written.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hnsw, op2_secrets, op3_pieces, op4_warc, op5_quality, op6_suffix, op7_mtree, op8_mixing, op9_simhash, op10_sharding)}


_MIX_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS w, sum(n)::DOUBLE AS n FROM counts),
rates AS (SELECT c.source, pow(c.n::DOUBLE, 0.5) / s.w * s.n / c.n AS rate FROM counts c, sums s),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
tables AS (SELECT source, rate, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source, rate),
numbered AS (
  SELECT *, md5(concat_ws(':', md5(coalesce('=' || doc_id::VARCHAR, '-')), md5(coalesce('=' || lang, '-')), md5(coalesce('=' || n_chars::VARCHAR, '-')),
      md5(coalesce('=' || source, '-')), md5(coalesce('=' || text, '-')))) AS row_id,
    row_number() OVER (PARTITION BY doc_id, lang, n_chars, source, text) - 1 AS occ
  FROM documents
),
draws AS (
  SELECT d.doc_id, d.source, length(d.text) AS text_chars, d.row_id, d.occ, t.rate, t.cdf,
    CAST('0x' || substr(md5(concat_ws(':', '17', d.row_id, d.occ)), 1, 13) AS UBIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM numbered d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
),
counted AS (SELECT *, len(list_filter(cdf, lambda c: c <= u)) AS copies FROM draws)
SELECT doc_id, source, text_chars, copy, copies, round(rate, 9) AS rate, md5(concat_ws(':', '17', row_id, occ, copy)) AS mix_order
FROM (SELECT *, unnest(range(copies)) AS copy FROM counted)
"""


def oracle_sql() -> dict[str, str]:
    """op8 in SQL; the others are tested against brute force, as SQL lacks their hashes, metrics or automata."""
    return {"op8_mixing": _MIX_SQL}
