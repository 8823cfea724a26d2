"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a run of frames and
a seek table in a skippable frame at its end, so any Zstandard reader can read it through and
a seeking one finds a frame by the table. An index maps each record's identifier to its
bundle, frame, and offset and length within the frame. Bundles and index are written and read
by Spark as a table in the shared folder, which works on any store and survives lost
executors; ``save_bundles`` puts them into ``.warc.zst`` files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, written

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 4 << 20
#: Fixed values of the Zstandard formats: skippable frame, seek table footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames, and frames into one bundle."""

    def __init__(self, level: int = 3):
        self._level = level
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self._open, self._size, self.bytes = [], 0, 0

    def add(self, identifier: str, record: bytes) -> None:
        self.index.append((identifier, len(self.frames), self._size, len(record)))
        self._open.append(record)
        self._size += len(record)
        if self._size >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self._open:
            raw = b"".join(self._open)
            frame = zstandard.ZstdCompressor(level=self._level).compress(raw)
            self.frames.append((frame, len(raw)))
            self.bytes += len(frame)
            self._open, self._size = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(f for f, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer


def seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """Begin and compressed size of each frame."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("not a bundle with a plain seek table")
    out, at = [], 0
    for size, _ in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((at, size))
        at += size
    return out


def _frame(bundle: bytes, place: tuple[int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[place[0] : place[0] + place[1]])


def read_at(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, by its index entry; no other frame is decompressed."""
    return _frame(bundle, seek_table(bundle)[frame])[offset : offset + length]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and HTTP body of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        yield head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + len(block) + 4


def _write(batches):
    def row(w: BundleWriter):
        data = w.finish()
        ids, frames, offsets, lengths = zip(*w.index, strict=True)
        return pa.RecordBatch.from_pydict({
            "bundle_id": [hashlib.sha256(data).hexdigest()], "bundle": [data], "record_ids": pa.array([ids], pa.list_(pa.string())), "frames": pa.array([frames], pa.list_(pa.int32())),
            "offsets": pa.array([offsets], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
        })

    w = BundleWriter()
    for batch in batches:
        columns = [batch[c] for c in ("page_id", "url", "html", "keeper", "revisit")]
        for i in range(batch.num_rows):
            page, url, html, keeper, revisit = (c[i].as_py() for c in columns)
            w.add(record_id(page), _record(page, url, (html or "").encode(), keeper, revisit))
            if w.bytes >= BUNDLE_BYTES:
                yield row(w)
                w = BundleWriter()
    if w.index:
        yield row(w)


def _read(batches):
    def page(value: str | None) -> str | None:
        value = value and value.strip("<>").removeprefix("urn:page:")
        return None if value in (None, "null") else value

    for batch in batches:
        for bundle in batch["bundle"]:
            data, rows = bundle.as_py(), {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for place in seek_table(data):
                for head, body in parse(_frame(data, place)):
                    kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(body) != said or len(body) != int(head["x-payload-length"])):
                        raise ValueError(f"{head['warc-record-id']}: the payload is not what its record says")
                    for k, v in zip(rows, (page(head["warc-record-id"]), int(head["x-payload-length"]), said, kind, page(head.get("warc-refers-to"))), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "payload_bytes" else pa.string()) for k, v in rows.items()})


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row; returns the written table of bundles with their index arrays.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the largest id is the
    response, others revisit it; shorter ones are all responses. Null html is an empty payload, a
    null url has no target line; a null id is less than any; rows that repeat the largest id are
    all responses; an empty table makes no bundle; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("k", F.sha2("html", 256))
    often = rows.where(F.octet_length("html") >= min_bytes).groupBy("k").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("k", "keeper")
    rows = rows.join(often, "k", "left").withColumn("revisit", F.coalesce(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False)))
    return written(rows.select("page_id", "url", "html", "keeper", "revisit").mapInArrow(_write, "bundle_id string, bundle binary, record_ids array<string>, frames array<int>, offsets array<bigint>, lengths array<bigint>"), "bundles")


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset (within the frame), length."""
    return bundles.select("bundle_id", F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("x")).select(F.col("x.record_ids").alias("record_id"), "bundle_id", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("length"))


def read_archives(bundles: DataFrame, id_type: str = "bigint") -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A payload that differs from its digest is an error."""
    out = bundles.select("bundle").mapInArrow(_read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def save_bundles(bundles: DataFrame, folder: str) -> list[str]:
    """Writes each bundle to its own file in a folder that the driver sees, one at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    names = []
    for row in bundles.select("bundle_id", "bundle").toLocalIterator():
        names.append(os.path.join(folder, f"{row.bundle_id}.warc.zst"))
        with open(names[-1], "wb") as f:
            f.write(row.bundle)
    return names
