"""WARC archives as seekable Zstandard bundles.

A task writes its records to one bundle, rolled at `bundle_bytes`. Records are grouped
into independent Zstandard frames of about `frame_bytes`; a skippable frame with a seek
table (compressed and plain size of each frame) ends the bundle. The index, a table,
maps a record to bundle, frame and offset inside the frame, so one record costs one
range read. Equal payloads of at least `min_revisit` bytes are stored once: the record
with the smallest id is the response, the others are revisits that name it.

Bundles go to the shared folder under names no other attempt uses; only the index,
written as a table after the tasks succeeded, says which bundles count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.llm.common import keep_table, only, store
from tallyglass.session import fresh_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1          # fixed values of the seekable format
FOOTER = struct.Struct("<IBI")
INDEX = "page_id bigint, record_type string, bundle string, frame int, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # the URL namespace


def plan_records(pages: DataFrame, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null: a response). Null payloads are empty."""
    p = only(pages, page_id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    p = p.withColumns({"page_id": F.col("page_id").cast("bigint"), "digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    first = p.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "size", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def _header(lines: Iterable[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode()


def format_record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only. URL characters that could end a header line are escaped."""
    revisit = refers_to is not None
    target = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    block = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + b"\r\n" + (b"" if revisit else payload)
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Target-URI", target), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to) if revisit else None), ("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The fields of RECORD from one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or len(rest) < int(fields["Content-Length"]):
        raise ValueError("not a whole WARC record")
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda key: int(fields[key]) if key in fields else None
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
    else:
        payload = None
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], digest, size, number("X-Refers-To-Page-ID"), payload


class BundleWriter:
    """Frames of records and, at the end, the seek table."""

    def __init__(self, out, frame_bytes: int, level: int):
        from zstandard import ZstdCompressor

        self.out, self.frame_bytes, self.zstd = out, frame_bytes, ZstdCompressor(level=level)
        self.frames, self.held, self.size, self.written = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        at = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._flush()
        return at

    def _flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + FOOTER.pack(len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        count, flags, magic = FOOTER.unpack(file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != SEEKABLE or flags:
            raise ValueError("no seek table")
        sizes = struct.unpack(f"<{2 * count}I", file.read_at(8 * count, end - FOOTER.size - 8 * count))
        self.frames, at = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2]):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        from zstandard import ZstdDecompressor

        at, packed, plain = self.frames[number]
        return ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def write_archives(records: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 30, level: int = 3,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the planned records below `folder` (default: a new one in the shared folder); returns the index table.

    One row per record, repeated ids included. A record larger than a frame is a frame
    of its own. An empty table gives an empty index and no bundle.
    """
    spark = records.sparkSession
    folder = folder or fresh_path(spark, "warc")
    spark.createDataFrame([], "x int").write.mode("append").parquet(f"{folder}/made")     # makes the folder in whatever store it is

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, path = None, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if bundle is None:
                        path = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
                        files, inner = store(path)
                        bundle = BundleWriter(files.open_output_stream(inner, compression=None), frame_bytes, level)
                    record = format_record(page_id, url, payload, digest, size, refers_to, date)
                    frame, offset = bundle.add(record)
                    rows.append((page_id, "response" if refers_to is None else "revisit", path, frame, offset, len(record)))
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
        finally:
            if bundle is not None:
                bundle.close()
    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    return keep_table(records.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, task_bytes: int = 32 << 20) -> DataFrame:
    """The records that the index rows name (all, or those a filter leaves), with the columns of RECORD.

    Frames are dealt to tasks of about `task_bytes`; each is read by its range in the bundle and unpacked once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = reader = None
        for batch in batches:
            for bundle, number, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != path:
                    files, inner = store(bundle)
                    path, reader = bundle, BundleReader(files.open_input_file(inner))
                data = reader.frame(number)
                rows = [parse_record(data[s["offset"]:s["offset"] + s["length"]]) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    # a row here stands for a frame of a megabyte: the number of tasks follows the records' bytes, not the rows'
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // task_bytes)
    return frames.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(parse, RECORD)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write all pages and read the archives back: RECORD columns, one row per page.

    Response: smallest id of an equal payload of at least 100 bytes (rows that share that
    id are all responses), or any shorter payload. Pages without an id are archived too;
    they refer to the smallest id of their payload if there is one, else are responses.
    """
    return read_records(write_archives(plan_records(pages), **options))
