"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole
WARC records, with a seek table (a skippable frame) at its end.  An index
table maps each record identifier to bundle, frame and the offset in the
uncompressed frame, so one record costs one frame's reading.

Defined cases: a null payload is an empty one; a null url has no target
header; a null record id is written as such and read back as null; equal
payloads whose ids are all null are responses; rows that repeat the smallest
id and payload are responses each; an empty table gives no bundle and no row.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import mapped, new_folder, settled, table, written

SKIPPABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
ID_PREFIX = "urn:record:"
INDEX = "record_id long, bundle string, frame long, frame_offset long, record_bytes long"
RECORD = INDEX + ", record_type string, url string, refers_to long, payload_bytes long, payload_digest string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store a URI names (file, hdfs, s3, gs ...) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def record_bytes(record_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) leaves the payload out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if record_id is None else record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at an offset, and where it ends."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = lambda k: int(x) if (x := head[k].removeprefix(f"<{ID_PREFIX}").rstrip(">")) else None
    url = head.get("WARC-Target-URI")
    out = {
        "record_id": number("WARC-Record-ID"), "record_type": head["WARC-Type"],
        "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "refers_to": number("WARC-Refers-To") if "WARC-Refers-To" in head else None,
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload,
    }
    return out, end + 4 + len(block) + 4


class BundleWriter:
    """One bundle, frame by frame; memory is that of one frame."""

    def __init__(self, uri: str, level: int, frame_bytes: int):
        fs, path = file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.uri, self.frame_bytes = fs.open_output_stream(path, compression=None), uri, frame_bytes
        self.zstd, self.frame, self.entries, self.written = zstandard.ZstdCompressor(level=level), bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.entries), len(self.frame)
        self.frame += record
        return place

    def flush(self) -> None:
        packed = self.zstd.compress(bytes(self.frame))
        self.out.write(packed)
        self.entries.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame.clear()

    def close(self) -> None:
        if self.frame:
            self.flush()
        table_ = b"".join(struct.pack("<II", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table_)) + table_)
        self.out.close()


class BundleReader:
    """Random access to a bundle's frames through its seek table."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        entries = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", entries):
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)

    def record(self, frame: int, offset: int) -> dict:
        return parse_record(self.frame(frame), offset)[0]

    def close(self) -> None:
        self.file.close()


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(record_id, url, payload, sha1, refers_to): of equal payloads of at least so many bytes the smallest id is the response."""
    rows = pages.select("record_id", "url", F.coalesce("payload", F.lit("").cast("binary")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and first_id is not null").drop("copies")
    first = written(first, "warc-first")  # with no aggregation right behind the join, a payload that most rows share can be split over several tasks
    refers = F.when((F.octet_length("payload") >= min_revisit_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "sha1", "left").select("record_id", "url", "payload", "sha1", refers.alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, level: int = 3, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28) -> DataFrame:
    """Writes bundles below folder and the index to folder/index; returns the index.

    A bundle's name holds the task attempt, and the index, which Spark commits,
    names the bundles that count: what a lost or repeated task left is ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        for batch in batches:
            rows = []
            for rid, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = BundleWriter(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.zst", level, frame_bytes)
                    n += 1
                data = record_bytes(rid, url, payload, digest32(bytes.fromhex(sha1)), refers)
                rows.append((rid, out.uri, *out.add(data), len(data)))
                if out.written >= bundle_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["record_id", "bundle", "frame", "frame_offset", "record_bytes"])
        if out is not None:
            out.close()

    records.select("record_id", "url", "payload", "sha1", "refers_to").transform(mapped, write, INDEX).write.parquet(f"{folder}/index")
    return records.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles named in column bundle, read frame by frame through the seek table.

    The digest of a response's payload is computed anew and held against its header.
    """
    kinds = dict(record_id=pa.int64(), bundle=pa.string(), frame=pa.int64(), frame_offset=pa.int64(), record_bytes=pa.int64(), record_type=pa.string(), url=pa.string(), refers_to=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader = BundleReader(uri)
                for k in range(len(reader.frames)):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        record, end = parse_record(data, at)
                        if record["record_type"] == "response":
                            found = digest32(hashlib.sha1(record["payload"]).digest())
                            if found != record["payload_digest"] or len(record["payload"]) != record["payload_bytes"]:
                                raise ValueError(f"{uri}, frame {k}, offset {at}: the payload does not match its digest")
                        rows.append(record | {"bundle": uri, "frame": k, "frame_offset": at, "record_bytes": end - at})
                        at = end
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))
                reader.close()

    return bundles.select("bundle").transform(mapped, read, RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page into bundles, and every record back from them; then the bundles go."""
    return settled(spark, "warc-records", lambda: there_and_back(spark, sf_dir))


def there_and_back(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("record_id"), "url", F.col("html").cast("binary").alias("payload"))
    index = write_bundles(mark_revisits(pages), new_folder(spark, "warc"))
    bundles = index.select("bundle").distinct()
    back = read_bundles(bundles.repartition(max(1, bundles.count())))
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM g
"""
