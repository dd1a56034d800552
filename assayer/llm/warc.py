"""WARC archives: one gzip member per record, written through Spark, read back sequentially and verified."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.text import stored
from assayer.session import fresh_path

# fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip member
PAD = "\u0000"  # gzip readers skip zero bytes between members
CHUNK = 1 << 16
BATCH = 8 << 20  # bytes that are handed on at once
#: Packed bytes of an archive, which is read back as one value and so has to stay below 2 GB.
ARCHIVE = 64 << 20
RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary()),
])
FIELDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " verified boolean, payload binary"
)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, date: str) -> bytes:
    """One record: a response, or a revisit of page ``original``, which carries the HTTP headers and no payload."""
    name = "" if page_id is None else page_id
    target = f"urn:page:{name}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if original is None else b"")
    fields = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": _sha1(payload),
        "WARC-Block-Digest": _sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if original is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{original}>", "WARC-Profile": PROFILE}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member of an archive in turn, decompressed piece by piece."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        unpacker, parts = zlib.decompressobj(GZIP), []
        while not unpacker.eof:
            piece = view[at:at + CHUNK]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def _named(value: str | None) -> int | None:
    digits = (value or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def parse(content: bytes) -> dict:
    """The fields of one record; raises ValueError where version, lengths or frame are not as the format asks."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION or not gap:
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("content length and record do not agree")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, kind = int(stated["Content-Length"]), fields["WARC-Type"]
    sound = fields["WARC-Block-Digest"] == _sha1(block)
    if kind == "response":
        sound = sound and fields["WARC-Payload-Digest"] == _sha1(payload) and size == len(payload)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {
        "page_id": _named(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": _named(fields.get("WARC-Refers-To")),
        "verified": sound, "payload": payload if kind == "response" else None,
    }


def _packing(date: str, most: int):
    """Members row by row, so that a batch of long pages is never held packed and unpacked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, held = [], 0
            for i in range(batch.num_rows):
                packed.append(record(*[c[i].as_py() for c in batch.columns], date))
                held += len(packed[-1])
                if len(packed[-1]) > most:
                    raise ValueError(f"a record of {len(packed[-1])} bytes is larger than an archive may be ({most})")
                if held > BATCH:
                    yield pa.record_batch([pa.array(packed, pa.binary())], names=["member"])
                    packed, held = [], 0
            yield pa.record_batch([pa.array(packed, pa.binary())], names=["member"])

    return run


def _numbering(size: int):
    """(archive, value): members in their order, with a number that rises where an archive would exceed ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held = 0, 0
        for batch in batches:
            numbers = []
            for i in range(batch.num_rows):
                length = len(batch.column(0)[i].as_buffer())
                if held and held + length > size:
                    archive, held = archive + 1, 0
                held += length
                numbers.append(archive)
            yield pa.record_batch([pa.array(numbers, pa.int32()), batch.column(0)], names=["archive", "value"])

    return run


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for content in members(batch.column(0)[i].as_py()):
                rows.append(parse(content))
                held += len(content)
                if held > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)


def write_archives(
    pages: DataFrame, path: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", records: int = 5000, size: int = ARCHIVE
) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to gzip archives in the folder ``path``.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least ``least`` bytes, the rows with the
    largest page_id are responses and the others revisits of it; smaller ones are all responses, as are payloads with
    no id at all. A null url becomes the page's own name; a null page_id stays null. An empty table writes no record.

    Spark's text writer commits the files, so failed and repeated tasks leave nothing behind and any file system that
    Spark writes will do; the byte it puts after each line is the zero with which gzip members may be padded.

    Archives are bounded in two ways. Each task of the writer packs its pages in order and opens a new archive where
    the next record would bring the present one over ``size`` bytes: the number of the archive is the folder a record goes
    to, and the writer holds one open file at a time, since these numbers only rise within a task. Within a folder a file
    has at most ``records`` records. A record that is larger than ``size`` has an archive of its own; one over 2 GB, which
    no reader could take as one value, is an error.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sealed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = large.where(F.col("size") >= least).groupBy("digest")
    shared = groups.agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    originals = stored(shared.select("digest", "original"), "originals")
    # null-safe: a page without an id revisits the original as well
    own = F.col("page_id").eqNullSafe(F.col("original"))
    typed = sealed.join(originals, "digest", "left").withColumn("original", F.when(~own, F.col("original")))
    packed = typed.select("page_id", "url", "payload", "original").mapInArrow(_packing(date, (1 << 31) - 1), "member binary")
    numbered = packed.mapInArrow(_numbering(size), "archive int, value binary")
    lines = numbered.select("archive", F.col("value").cast("string").alias("value"))
    writer = lines.write.partitionBy("archive").option("lineSep", PAD).option("maxRecordsPerFile", records)
    writer.text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``; ``verified`` says whether its digests and lengths hold.

    Each archive is read from start to end: gzip members one after the other, each unpacked piece by piece and framed by
    its content length. A file that is cut short, or a record that is not framed as stated, is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInArrow(_reading, FIELDS)
    return rows if payloads else rows.drop("payload")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and return what their records say."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).drop("url")
