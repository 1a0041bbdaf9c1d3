"""Deterministic sharded WARC archives.

Records are range-sorted by page id, each partition is written in files rolled by their compressed size, headers and digests
are made anew, and equal payloads are stored once: the record with the smallest id is the response, the others revisit it.
A file is written under a temporary name with the attempt in it and then renamed, so a lost executor's task can run again; what
a late attempt may still rename has the same bytes. The manifest, one file with a line an archive (its records, bytes and
SHA-256), comes under its own name last and is the commit: readers read the files that it lists and no others, and hold each
against its line.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilgrid.llm.common import salts, shared_folder

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_FILE = "manifest.jsonl"
MANIFEST = "file string, records bigint, bytes bigint, sha256 string"
_KEYS = ["sha256", "size"]


def _pack(batches: Iterator[pa.RecordBatch], parts: int, squeeze=None) -> Iterator[pa.RecordBatch]:
    """id, url, payload -> id, salt (one of parts, by id), url, digests, size, compressed payload."""
    squeeze = squeeze or zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        data = [(t or "").encode() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([xxhash.xxh32_intdigest(repr(i).encode()) % parts for i in b.column(0).to_pylist()], pa.int32()),
                b.column(1),
                pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in data], pa.string()),
                pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                pa.array([len(x) for x in data], pa.int64()),
                pa.array([squeeze(x) for x in data], pa.binary()),
            ],
            ["id", "salt", "url", "sha1", "sha256", "size", "packed"],
        )


def _digests(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What of _pack's rows tells equal payloads."""
    for b in _pack(batches, parts, bytes):
        yield b.select(["id", "salt", "sha256", "size"])


def _clean(value, also: str = "") -> str:
    """A header value on one line: control characters, and those in `also`, as %XX."""
    return "".join(c if c >= " " and c != "\x7f" and c not in also else f"%{ord(c):02X}" for c in str(value))


def _plain(value: str) -> str:
    """Undoes _clean(value, "%")."""
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def record(page_id, url, sha1: str, size: int, payload: bytes | None, refers_to, nth: int) -> bytes:
    """One WARC record; payload None: a revisit of page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, sha1) if payload is not None and nth == 0 else _urn(page_id, sha1, 'again', nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {_clean(page_id, '%')}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, sha1)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {_clean(refers_to, '%')}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = 64 << 20, min_payload: int = 0) -> DataFrame:
    """Write the archives and their manifest under folder (a URI all executors reach); returns the manifest.

    Of equal payloads of at least min_payload bytes the record with the smallest id is the response (of repeated rows with that
    id just one), others are revisits; smaller payloads are all responses. Null payload: empty. Null url: no target header.
    A null id counts as larger than all others. Ids may hold any characters; control characters in a URL are written %XX, and
    stay so. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    kinds = f"id {kind}, salt int, url string, sha1 string, sha256 binary, size bigint, packed binary"
    parts = salts(spark)
    packed, digests = src.mapInArrow(partial(_pack, parts=parts), kinds), src.mapInArrow(partial(_digests, parts=parts), f"id {kind}, salt int, sha256 binary, size bigint")
    classes = (
        digests.where(F.col("size") >= min_payload)
        .groupBy(*_KEYS, "salt").agg(F.min("id").alias("first"))
        .groupBy(*_KEYS).agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
        .select(*_KEYS, "first", F.explode("salts").alias("salt"))
    )
    # row_number tells apart repeated rows of the first id: url decides, then nothing does, as they are alike.
    nth = F.row_number().over(W.partitionBy(*_KEYS, "salt", "id").orderBy("url")) - 1
    rows = packed.join(classes, [*_KEYS, "salt"], "left").withColumn("nth", nth)
    small = F.col("size") < min_payload
    rows = rows.withColumn("response", small | (F.col("id").eqNullSafe(F.col("first")) & (F.col("nth") == 0)))
    rows = rows.select("id", "url", "sha1", "size", "packed", "response", "nth", F.when(~F.col("response"), F.col("first")).alias("refers_to"))
    ranged = rows.withColumn("unnamed", F.col("id").isNull()).repartitionByRange("unnamed", "id", "sha1", "nth").sortWithinPartitions("unnamed", "id", "sha1", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs.create_dir(f"{root}/_temporary", recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress
        done, out, seq = [], None, 0

        def close():
            nonlocal out, seq
            stream, temp, digest, size, n = out
            stream.close()
            name = f"part-{part:06d}-{seq:05d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            done.append((name, n, size, digest.hexdigest()))
            out, seq = None, seq + 1

        for b in batches:
            for r in b.to_pylist():
                payload = unpack(r["packed"]) if r["response"] else None
                member = gzip.compress(record(r["id"], r["url"], r["sha1"], r["size"], payload, r["refers_to"], r["nth"]), 6, mtime=0)
                if out is None:
                    temp = f"{root}/_temporary/{part:06d}-{seq:05d}-{attempt}"
                    out = [fs.open_output_stream(temp), temp, hashlib.sha256(), 0, 0]
                out[0].write(member)
                out[2].update(member)
                out[3] += len(member)
                out[4] += 1
                if out[3] >= roll_bytes:
                    close()
        if out is not None:
            close()
        cols = list(zip(*done)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["file", "records", "bytes", "sha256"])

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    made = f"{folder}/_temporary/manifest"
    ranged.select("id", "url", "sha1", "size", "packed", "response", "nth", "refers_to").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(made)
    # A line an archive of roll_bytes or so, streamed a partition at a time.
    temp = f"{root}/_temporary/{MANIFEST_FILE}"
    with fs.open_output_stream(temp, compression=None) as out:
        for r in spark.read.schema(MANIFEST).parquet(made).orderBy("file").toLocalIterator():
            out.write(json.dumps(r.asDict()).encode() + b"\n")
    fs.move(temp, f"{root}/{MANIFEST_FILE}")
    fs.delete_dir(f"{root}/_temporary")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """file, records, bytes, sha256 of each committed archive."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{folder}/{MANIFEST_FILE}")


class _Watched(io.RawIOBase):
    """A stream that counts and digests what is read."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        self.size += len(data)
        self.digest.update(data)
        return len(data)


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def read_warc(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Read the committed archives back, a file a task: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits).

    It raises an error where an archive is missing, where its records, bytes or digest aren't those of the manifest, and where a
    block or payload differs from its digest.
    """
    manifest = manifest_of(spark, folder)
    number = id_type in ("tinyint", "smallint", "int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        ident = lambda x: None if x is None else int(x) if number else _plain(x)
        for b in batches:
            for entry in b.to_pylist():
                name, rows, held, count = entry["file"], [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    watched = _Watched(raw)
                    stream = gzip.GzipFile(fileobj=io.BufferedReader(watched, 1 << 20))
                    for head, block in records_of(stream):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block differs from its digest")
                        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((ident(head.get("X-Page-ID")), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]) if payload is None else len(payload), digest, head["WARC-Type"], ident(head.get("X-Refers-To-Page")), payload))
                        held += len(block)
                        count += 1
                        if held > 8 << 20:
                            yield _rows(rows, number)
                            rows, held = [], 0
                    if (count, watched.size, watched.digest.hexdigest()) != (entry["records"], entry["bytes"], entry["sha256"]):
                        raise ValueError(f"{name}: not the archive that the manifest lists")
                yield _rows(rows, number)

    kind = "bigint" if number else "string"
    # A stated number of partitions isn't merged, however small the list of names is.
    files = manifest.repartitionByRange(max(1, manifest.count()), "file")
    return files.mapInArrow(run, f"page_id {kind}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, payload binary")


def _rows(rows: list[tuple], number: bool) -> pa.RecordBatch:
    kind = pa.int64() if number else pa.string()
    types = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
    cols = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a new folder under the shared one and read the archives back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_warc(pages, folder, **options)
    return read_warc(spark, folder, dict(pages.dtypes)[options.get("id_col", "page_id")])
