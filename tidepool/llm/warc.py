"""WARC archives with Zstandard compression, written and read by Spark tasks.

An archive starts with a skippable frame that holds the dictionary; then each
record is one frame.  Every attempt of a task writes archives under names of
its own to a shared folder, and the rows that tell of them go to a manifest
table, which takes one attempt of each task; readers open the manifest's
archives only.  So a task that runs again after a lost executor, or twice at a
time, may cut its rows elsewhere, and no record is read twice or lost.  Readers
take the dictionary from the leading frame, find each frame's end, and validate
the version line, the header fields, all lengths and all digests.

Equal payloads are found by digest.  Payloads of so many rows that one task
could not hold them (at most 1000 of them, as each has a thousandth of all
rows) are looked up in a broadcast table and their rows dealt out; the others
meet their group in a join.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch, shuffle_partitions

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of more rows than this, and than a thousandth of all, do not meet in one task.
CROWD = 1000
_WINDOW = 1 << 16


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_number(name: str) -> int | None:
    tail = name.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; `problem` says what is wrong with it, if anything."""
    out = {"page_id": None, "url": None, "payload_bytes": None, "payload_digest": None, "record_type": None, "refers_to": None, "payload": None, "problem": None}
    try:
        head, mark, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not mark or version != VERSION:
            raise ValueError("version line")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block, tail = rest[:size], rest[size:]
        if len(block) != size or tail != b"\r\n\r\n":
            raise ValueError("record length")
        if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
            raise ValueError("block digest")
        http, mark, payload = block.partition(b"\r\n\r\n")
        status, *http_lines = http.decode().split("\r\n")
        if not mark or not status.startswith("HTTP/1.1 "):
            raise ValueError("status line")
        length = int(dict(x.split(": ", 1) for x in http_lines)["Content-Length"])
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        out |= {"page_id": page_number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": kind}
        if kind == "response":
            if len(payload) != length:
                raise ValueError("payload length")
            if digest32(payload) != digest:
                raise ValueError("payload digest")
            out["payload"] = payload
        elif kind == "revisit":
            if payload or fields["WARC-Profile"] != REVISIT_PROFILE:
                raise ValueError("revisit")
            out["refers_to"] = page_number(fields["WARC-Refers-To"])
        else:
            raise ValueError("record type")
    except (ValueError, KeyError, UnicodeDecodeError) as e:
        out["problem"] = f"bad {e}"
    return out


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records; where there are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def archive(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    held = zstandard.ZstdCompressor(level=level).compress(dictionary)
    pressed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(held)), held, *map(pressed.compress, records)])


def read_archive(data: bytes | BinaryIO) -> Iterator[bytes]:
    """The bytes of each record of an archive, given whole or as an open file, of which a window is held at a time."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    start = source.read(8)
    magic, size = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
    dictionary = source.read(size) if magic == DICTIONARY_MAGIC else b""
    if magic != DICTIONARY_MAGIC or len(dictionary) < size:
        raise ValueError("no dictionary frame")
    if dictionary[:4] == FRAME_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    window = source.read(_WINDOW)
    while window:
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if not window:
                raise ValueError("a frame is cut off")
            parts.append(one.decompress(window))
            window = one.unused_data if one.eof else b""
            window = window or source.read(_WINDOW)
        yield b"".join(parts)


def _writer(folder: str, archive_bytes: int, dictionary_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        context, attempt = TaskContext.get(), uuid.uuid4().hex
        records, size, done = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{context.partitionId() if context else 0:06d}-{attempt}-{done:05d}.warc.zst"
            with where.open_output_stream(f"{path}/{name}") as f:
                f.write(archive(records, train(records[:500], dictionary_bytes)))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], ["archive", "records"])

        for b in batches:
            for row in b.to_pylist():
                r = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], date)
                records.append(r)
                size += len(r)
                if size >= archive_bytes:
                    yield flush()
                    records, size, done = [], 0, done + 1
        if records:
            yield flush()

    return write


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, archive_bytes: int = 32_000_000, dictionary_bytes: int = 16_384, date: str = "2025-01-01T00:00:00Z") -> str:
    """Write a record per row of `pages` (page_id, url, html); return the path of the manifest (archive, records).

    Rows whose payloads are equal and have at least `least_bytes` bytes are one
    response, that with the largest page_id, and revisits of it.  A null html
    is an empty payload; a null page_id counts as smaller than all others, and
    where a group has no other, all its rows are responses, as are all rows
    that share the largest page_id.
    """
    spark = pages.sparkSession
    parts = shuffle_partitions(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"),
    )
    groups = rows.groupBy("sha", "n").agg(F.max("page_id").alias("latest"), F.count("*").alias("many")).where(f"many > 1 and n >= {least_bytes}")
    groups = scratch.save(groups.select("sha", "latest", "many"), "groups")
    crowd = max(CROWD, pages.count() // 1000)
    crowds = groups.where(F.col("many") > crowd).select("sha", F.col("latest").alias("top"), F.lit(True).alias("crowded"))
    dealt = F.when(F.col("crowded"), F.concat(F.lit("~"), F.pmod(F.xxhash64("page_id", "url"), F.lit(4 * parts)).cast("string"))).otherwise(F.col("sha"))
    spread = rows.join(F.broadcast(crowds), "sha", "left").withColumn("key", dealt)
    named = spread.join(groups.where(F.col("many") <= crowd).select(F.col("sha").alias("key"), "latest"), "key", "left").withColumn("latest", F.coalesce("latest", "top"))
    named = named.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("latest")), F.col("latest")).alias("refers_to"))
    folder = f"{scratch.root}/archives"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    scratch.save(named.mapInArrow(_writer(folder, archive_bytes, dictionary_bytes, date), "archive string, records long"), "manifest")
    return f"{scratch.root}/manifest"


_FIELDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())]
)


def read_archives(spark: SparkSession, manifest: str) -> DataFrame:
    """One row per record of the archives of a manifest; records that are not valid have a `problem`.

    An archive that is cut off or holds more or fewer records than the
    manifest says gives a row with a problem after those that it has.
    """
    return records_of(spark.read.schema("archive string, records long").parquet(manifest))


def records_of(archives: DataFrame, held_bytes: int = 8_000_000) -> DataFrame:
    """As `read_archives`, of a table (archive, records) of paths or addresses; `records` may be null.

    Archives are dealt out by name and read a record at a time; a batch holds
    payloads of about `held_bytes`.  A damaged archive gives a row with its
    problem; one that is missing or can't be opened ends the job, as nothing can
    be told of its records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            held: list[dict] = []
            size = many = 0
            try:
                where, path = fs.FileSystem.from_uri(row["archive"])
                with where.open_input_stream(path) as f:
                    for r in read_archive(f):
                        held.append(parse_record(r))
                        many, size = many + 1, size + len(r)
                        if size >= held_bytes or len(held) == 1000:
                            yield pa.RecordBatch.from_pylist(held, schema=_FIELDS)
                            held, size = [], 0
                if row["records"] is not None and many != row["records"]:
                    raise ValueError(f"{many} of {row['records']} records")
            except (ValueError, zstandard.ZstdError) as e:
                held.append({"problem": f"bad archive: {e}"})
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_FIELDS)

    return archives.select("archive", "records").repartition(shuffle_partitions(archives.sparkSession), "archive").mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"
    )


def archive_round_trip(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write all rows of `pages` to archives and return what reading them gives, payloads left out.

    An empty table writes no archives and gives no rows.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, scratch)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )
