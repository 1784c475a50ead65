"""Web archives as seekable Zstandard bundles, written and read by Spark tasks.

A bundle is a sequence of independent frames, each with a few records, and a footer frame that holds
the seek table of the public "seekable format". Every task writes bundles of its own; the rows it
returns are the index (record, bundle, frame, offset), so files of tasks that were lost or ran twice
are in no index. Reading seeks to single frames.
"""

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import fresh_path, staged

FRAME_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, READ_BYTES = 1 << 20, 256 << 20, 16 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "record string, bundle string, frame int, frame_at long, frame_size long, record_at long, record_size long"
RECORD = ("record string, url string, record_type string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def duplicates(pages: DataFrame, id: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (id, digest, refers_to) of the pages that another page with an equal payload stands for.

    Of equal payloads of `least_bytes` or more the largest id is the response. Null payloads are empty.
    Rows without an id are responses and stand for none.
    """
    seen = pages.where(F.col(id).isNotNull() & (F.octet_length(_payload(payload)) >= least_bytes)).select(
        F.col(id).alias("id"), _digest(payload).alias("digest"))
    groups = seen.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("_least"))
    copied = staged(groups.where(F.col("_least") < F.col("refers_to")).drop("_least"), "copied")
    return staged(seen.join(copied, "digest").where(F.col("id") < F.col("refers_to")).distinct(), "revisits")


def _payload(name: str) -> Column:
    return F.encode(F.coalesce(F.col(name), F.lit("")), "utf-8")


def _digest(name: str) -> Column:
    return F.unhex(F.sha1(_payload(name)))


def _escaped(value: str, also: str = "") -> str:
    """`value` with what no header field or URI may hold, and the characters of `also`, as %XX."""
    return re.sub(rf"[\x00-\x20\x7f{also}]", lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def _named(record: str) -> str:
    return f"<urn:page:{_escaped(record, '%<>')}>"


def record_bytes(record: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(record)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _escaped(url))
        if _escaped(url) != url:  # other readers get a URI, this one the address as it was
            head.append("X-Address: " + _escaped(url, "%"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_named(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a frame; responses are checked against their digests."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        http, _, payload = data[start:start + size].partition(b"\r\n\r\n")
        whole = int(re.search(rb"Content-Length: (\d+)", http)[1])
        revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != whole or base32_sha1(payload) != digest):
            raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what was written")
        url = _plain(head["X-Address"]) if "X-Address" in head else head.get("WARC-Target-URI")
        yield {"record": _plain(head["WARC-Record-ID"][len("<urn:page:"):-1]), "record_type": head["WARC-Type"], "url": url,
               "refers_to": _plain(head["WARC-Refers-To"][len("<urn:page:"):-1]) if revisit else None,
               "payload_digest": digest, "payload_bytes": whole, "payload": None if revisit else payload}
        at = start + size + 4


class BundleWriter:
    """Frames of whole records up to FRAME_BYTES, and a seek table at the end."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.at, self.held, self.size, self.index = 0, [], 0, []

    def add(self, record: str, data: bytes) -> None:
        self.held.append((record, self.size, len(data), data))
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        packed = self.pack(b"".join(x[3] for x in self.held))
        self.sink.write(packed)
        self.index += [(r, len(self.frames), self.at, len(packed), at, n) for r, at, n, _ in self.held]
        self.frames.append((len(packed), self.size))
        self.at, self.held, self.size = self.at + len(packed), [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", FRAME_MAGIC, len(table)) + table)
        self.sink.close()


def seek_table(source) -> list[tuple[int, int]]:
    """(offset, size) of every frame, from the footer of an open bundle."""
    source.seek(source.size() - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != FOOTER_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(source.size() - 9 - width * count)
    table, at, out = source.read(width * count), 0, []
    for k in range(count):
        size = struct.unpack_from("<I", table, k * width)[0]
        out.append((at, size))
        at += size
    return out


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


def write(pages: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html",
          least_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of `pages` to bundles in `folder`; returns the written index.

    Equal payloads are written once, see `duplicates`; other columns are not archived. An empty table
    has an empty index. Rows that repeat an id with the same payload are records of the same kind.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    revisits = duplicates(pages, id, payload, least_bytes).select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("refers_to").cast("string"))
    rows = pages.join(revisits, (F.col(id) == F.col("_id")) & (_digest(payload) == F.col("_digest")), "left").select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("record"), F.col(url).cast("string").alias("url"),
        _payload(payload).alias("payload"), "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = path = None

        def ended():
            writer.close()
            columns = list(zip(*[(r, path, *rest) for r, *rest in writer.index]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [
                pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4])], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for k in range(batch.num_rows):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    system, inner = _opened(folder)
                    system.create_dir(inner, recursive=True)
                    writer = BundleWriter(system.open_output_stream(f"{inner}/{path.rsplit('/', 1)[1]}", compression=None))
                record, where, data, refers = (c[k].as_py() for c in batch.columns)
                writer.add(record, record_bytes(record, where, data, refers))
                if writer.at >= BUNDLE_BYTES:
                    yield ended()
                    writer = None
        if writer is not None:
            yield ended()

    return staged(rows.mapInArrow(work, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records of every frame that `index` names, read back through the bundles' seek tables."""
    frames = index.select("bundle", "frame", "frame_at", "frame_size").distinct()
    # by what is read, not by the few bytes of the index
    tasks = 1 + (frames.agg(F.coalesce(F.sum("frame_size"), F.lit(0))).first()[0] // READ_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
                            for n, t in (x.split() for x in RECORD.split(", "))])
        tables: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            for row in sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"])):
                system, inner = _opened(row["bundle"])
                with system.open_input_file(inner) as source:
                    if row["bundle"] not in tables:
                        tables = {row["bundle"]: seek_table(source)}
                    at, size = tables[row["bundle"]][row["frame"]]
                    if (at, size) != (row["frame_at"], row["frame_size"]):
                        raise ValueError(f"{row['bundle']}: seek table and index differ")
                    source.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(source.read(size))
                yield pa.RecordBatch.from_pylist(list(parsed(data)), schema=schema)

    return frames.repartition(int(tasks), "bundle", "frame").mapInArrow(work, RECORD)


def fetch(spark: SparkSession, index: DataFrame, records: DataFrame) -> DataFrame:
    """The records named in `records` (record), reading only their frames."""
    wanted = index.join(records.select("record").distinct(), "record", "left_semi")
    return read(wanted).join(records.select("record").distinct(), "record", "left_semi")
