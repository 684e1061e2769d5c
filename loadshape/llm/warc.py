"""WARC archives: writing, normalising monolithic gzip to a member per record, and reading back."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.llm.common import cut

# fixed values of the format
CRLF = "\r\n"
RECORD_END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
#: Digests with copies are broadcast up to this number (50 bytes each), and joined by shuffle beyond.
BROADCAST_DIGESTS = 500_000
#: Records in one archive file: bounds what a task holds, as an archive is read whole.
RECORDS_PER_FILE = 10_000
_READ_STEP, _INFLATE_STEP = 1 << 14, 1 << 20
_GZIP_HEADER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
#: A gzip member without content: Spark's text writer puts it after every record, where it adds nothing.
EMPTY_MEMBER = _GZIP_HEADER + b"\x03\x00" + bytes(8)


def plan_records(df: DataFrame, key: str, url: str, payload: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(key, url, payload, digest, refers_to): which record holds a payload and which refer to it.

    ``payload`` is text, NULL counting as empty; ``digest`` is the SHA-1 of its UTF-8 bytes.  Of records with equal
    payloads of at least ``least`` bytes the one with the largest ``key`` holds it, and the others name that
    key in ``refers_to``; rows that tie in the largest key all hold it, and so does a row without key.
    """
    held = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), held.alias("payload"), F.sha1(held).alias("digest"))
    copies = cut(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("key").alias("holder"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "holder")
    )
    side = F.broadcast(copies) if copies.count() <= BROADCAST_DIGESTS else copies
    return rows.join(side, "digest", "left").select(
        "key", "url", "payload", "digest", F.when(F.col("key") < F.col("holder"), F.col("holder")).alias("refers_to")
    )


def record_text(key: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC/1.1 record without its end, as text."""
    revisit = refers_to.isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(payload)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def urn(k: Column) -> Column:
        return F.concat(F.lit("<urn:record:"), k.cast("string"), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(key)),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", urn(refers_to)),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_monolithic(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """``records`` (one column of record texts) as WARC files, each a single gzip stream.

    Spark's text writer puts the records' end between the lines of a compressed file, which is just the format,
    and commits like every Spark output: a task that is run again leaves no trace.
    """
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


@dataclass
class _Splitter:
    """Cuts an inflated stream into records by their Content-Length, as the bytes come."""

    rest: bytes = b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.rest += data
        at = 0
        while (head := self.rest.find(b"\r\n\r\n", at)) >= 0:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", self.rest[at:head])
            if not length:
                raise ValueError("a record without Content-Length")
            end = head + 4 + int(length[1]) + 4
            if end > len(self.rest):
                break
            yield self.rest[at:end]
            at = end
        self.rest = self.rest[at:]


def _inflated(content: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset of the member, next bytes of its content) of a gzip file, read and inflated a step at a time."""
    at = 0
    while at < len(content):
        begin, stream = at, zlib.decompressobj(31)
        while not stream.eof:
            if at >= len(content):
                raise ValueError("a gzip stream that ends early")
            data = stream.decompress(content[at : at + _READ_STEP], _INFLATE_STEP)
            at = min(at + _READ_STEP, len(content))
            while data:
                yield begin, data
                data = stream.decompress(stream.unconsumed_tail, _INFLATE_STEP) if stream.unconsumed_tail else b""
        at -= len(stream.unused_data)


def _headers(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split(CRLF)
    fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    return fields, block[: int(fields["content-length"])]


def _record_key(urn: str | None) -> int | None:
    return int(urn[len("<urn:record:") : -1]) if urn else None


def _member(record: bytes) -> bytes:
    """A gzip member of its own, with nothing in it that depends on the time or the machine."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    return _GZIP_HEADER + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def normalise(spark: SparkSession, source: str, target: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Rewrite the gzip WARC files below ``source``, whole-file streams or not, with a member per record.

    Archives go to ``target``/archives, the sidecar index to ``target``/index: (archive, part, offset, length,
    record_key), where ``archive`` and ``part`` are the numbers in a file's name and offset and length cut one
    member out of it.  Every stream is inflated once, in steps, and its records are passed on one by one.  The members are
    kept on the executors' disks while both are written; what is lost with an executor is made again, to the same
    bytes.  After each record stands an empty member, which readers of gzip pass over.
    """
    schema = pa.schema(
        [("archive", pa.int32()), ("part", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
         ("record_key", pa.int64()), ("member", pa.binary())]
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, offset, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for content in batch.column("content"):
                splitter = _Splitter()
                for _, data in _inflated(memoryview(content.as_buffer())):
                    for record in splitter.feed(data):
                        member, key = _member(record), _record_key(_headers(record)[0].get("warc-record-id"))
                        if n % records_per_file == 0:
                            offset = 0
                        rows.append((archive, n // records_per_file, offset, len(member), key, member))
                        offset += len(member) + len(EMPTY_MEMBER)
                        n, size = n + 1, size + len(member)
                        if size > _INFLATE_STEP:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if splitter.rest.strip():
                    raise ValueError("a record that ends early")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("content")
    made = files.mapInArrow(
        members, "archive int, part int, offset long, length long, record_key long, member binary"
    ).persist(StorageLevel.DISK_ONLY)
    try:
        made.select(F.col("member").cast("string").alias("value")).write.option(
            "lineSep", EMPTY_MEMBER.decode("iso-8859-1")
        ).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(f"{target}/archives")
        made.drop("member").write.parquet(f"{target}/index")
    finally:
        made.unpersist()


def file_numbers(path: Column) -> tuple[Column, Column]:
    """Archive and part number, from the name that Spark gave the file."""
    return (
        F.regexp_extract(path, r"part-(\d+)-[^/]*$", 1).cast("int"),
        F.regexp_extract(path, r"-c(\d+)\.[^/]*$", 1).cast("int"),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, part, offset, record_key, record_type, refers_to, block_bytes, block_digest, payload_digest):
    the records of all archives below ``path``, member by member.

    ``block_digest`` is the SHA-1 of the bytes read, ``payload_digest`` what the header says of the full payload.
    """
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("record_key", pa.int64()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("block_bytes", pa.int64()), ("block_digest", pa.string()),
         ("payload_digest", pa.string())]
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, parts = [], groupby(_inflated(memoryview(content.as_buffer())), key=itemgetter(0))
                for begin, steps in parts:
                    record = b"".join(data for _, data in steps)
                    fields, block = _headers(record)
                    rows.append((
                        path, begin, _record_key(fields.get("warc-record-id")), fields["warc-type"],
                        _record_key(fields.get("warc-refers-to")), len(block), hashlib.sha1(block).hexdigest(),
                        fields["warc-payload-digest"].removeprefix("sha1:"),
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = files.mapInArrow(
        records,
        "path string, offset long, record_key long, record_type string, refers_to long, block_bytes long, "
        "block_digest string, payload_digest string",
    )
    archive, part = file_numbers(F.col("path"))
    return read.select(archive.alias("archive"), part.alias("part"), *[c for c in read.columns if c != "path"])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes``: of a revisit, those of the response it refers to.

    A response must have the digest its header names, and a revisit that of its response; else an error is raised.
    """
    sound = F.col("block_digest") == F.col("payload_digest")
    held = (
        records.join(records.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_key")).distinct(), "record_key", "left_semi")
        .where("record_type = 'response'")
        .select(F.col("record_key").alias("_to"), F.col("block_bytes").alias("_bytes"), F.col("block_digest").alias("_digest"))
        .distinct()
    )
    broken = F.raise_error(F.lit("a payload that is not what its digest says")).cast("long")
    size = F.when(
        F.col("record_type") == "revisit", F.when(F.col("_digest") == F.col("payload_digest"), F.col("_bytes")).otherwise(broken)
    ).otherwise(F.when(sound, F.col("block_bytes")).otherwise(broken))
    return records.join(held, F.col("refers_to") == F.col("_to"), "left").withColumn("payload_bytes", size).drop("_to", "_bytes", "_digest")
