"""WARC archives in Zstandard: a leading dictionary frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import ship

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: the text writer puts it after each row, and Zstandard readers pass over it.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
DIGEST_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most sample pages, and most bytes of dictionary, that the driver handles.
SAMPLE_PAGES, DICTIONARY_BYTES = 128, 65_536


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample payloads; empty if they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(size, [p for p in payloads if p]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only, with the full payload's length."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    block_digest = payload_digest(block)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{block_digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {DIGEST_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def parse_record(raw: bytes) -> dict:
    """Headers and payload of a record; ValueError if its version, lengths or digests are wrong."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise ValueError("not a WARC record")
    head = _headers(raw[:end])
    length = int(head["content-length"])
    block = raw[end + 4 : end + 4 + length]
    if len(block) != length or raw[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')} isn't of its Content-Length")
    if head["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"record {head.get('warc-record-id')} fails its block digest")
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("no HTTP header")
    size, payload = int(_headers(block[:cut])["content-length"]), block[cut + 4 :]
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {head['warc-record-id']} fails its payload digest")
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": number(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    head = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    pos = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if pos + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            pos += 4 * head.has_checksum
            if pos > len(data):
                raise ValueError("a frame is cut off")
            return pos


def read_archive(content: bytes) -> Iterator[bytes]:
    """Records of an archive. A leading skippable frame has the dictionary, itself perhaps compressed; others are passed over."""
    data, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == 0x184D2A5:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0 and size:
                body = bytes(data[8 : 8 + size])
                body = zstandard.ZstdDecompressor().decompress(body) if body[:4] == zstandard.FRAME_HEADER else body
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif magic == zstandard.MAGIC_NUMBER:
            end = frame_end(data, at)
            yield unpack.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def sample_dictionary(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", sample: int = SAMPLE_PAGES) -> bytes:
    """A dictionary trained on at most ``sample`` pages, those whose ids hash lowest; of these, pages over 64 KB are left out."""
    ids = pages.select(F.col(id_col).alias("p"), F.xxhash64(id_col).alias("h")).orderBy("h", "p").limit(sample).select("p").collect()
    rows = pages.where(F.col(id_col).isin([r.p for r in ids if r.p is not None])).where(F.octet_length(body_col) <= 1 << 16).select(F.col(body_col).alias("b")).limit(sample).collect()
    return train_dictionary([(r.b or "").encode("utf-8", "surrogatepass") for r in rows])


def revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` with sha1, and refers_to: of rows with equal payloads of at least ``min_bytes``, the largest id, else null.

    Only digests that repeat reach the join, and a hot digest's rows may be split over tasks. Null bodies are empty; columns
    of these names are replaced.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    keyed = pages.drop("refers_to").withColumn("sha1", F.sha1(body.cast("binary")))
    same = keyed.where(F.octet_length(body) >= min_bytes).groupBy("sha1").agg(F.max(id_col).alias("refers_to"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return keyed.join(same, "sha1", "left")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, level: int = 3, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 32 << 20) -> None:
    """Write archives of about ``archive_bytes`` under ``path`` with Spark's own committed writer, on any Hadoop file system.

    A task rolls its archives: each is one row of the writer's, and a file of its own; one record may be larger than that.
    Rows equal in id and payload are all responses; a null id is the least; null bodies are empty; no rows, no records.
    Ids are whole 64-bit integers; other columns of ``pages`` take no part.
    """
    ship(pages.sparkSession)
    used = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).alias("html"))
    dictionary = sample_dictionary(used)
    rows = revisits(used, min_bytes=min_bytes).select("page_id", "url", "html", "refers_to")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        parts, held = [head], len(head)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])

        for batch in batches:
            for page, url, html, refers in zip(*batch.columns, strict=True):
                page, refers = page.as_py(), refers.as_py()  # never by way of floats
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                revisit = refers is not None and refers != page
                parts.append(pack.compress(format_record(page, url.as_py(), payload, payload_digest(payload), refers, revisit, date)))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield out()
                    parts, held = [head], len(head)
        if len(parts) > 1:
            yield out()

    packed = rows.mapInArrow(archive, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str, payloads: bool = False, batch_rows: int = 1000) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all archives under ``path``.

    Every record's header, lengths and digests are checked; a wrong one fails the read. Rows go out ``batch_rows`` at a time.
    """
    ship(spark)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), **({"payload": pa.binary()} if payloads else {})}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = map(parse_record, read_archive(content.as_py()))
                while rows := list(islice(found, batch_rows)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in kinds.items()], names=list(kinds))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, schema)
