"""WARC archives in seekable Zstandard bundles.

A bundle is a file of records grouped into independent Zstandard frames of about ``FRAME`` bytes. Two skippable frames
end it: a map from record identifier to frame and offset within the frame's content, then the seek table of
the seekable format, with each frame's compressed and plain size. A record is read by two reads of the file's end and one of its
frame, which alone is decompressed.

Tasks write bundles under names of their own into a folder of the shared one, and a manifest, a table written by Spark's own committed writer,
names those of the tasks that ended: files that a lost executor left behind are in no manifest. The shared folder is reached through
Arrow's file systems, so it may be a mounted path or a store that Arrow knows.

Of records with equal payloads of ``LEAST`` bytes or more the one with the greatest identifier is a response
and the others revisit it. A response holds its payload behind the headers of an HTTP response, a revisit those headers alone.

Defined cases: a null payload is empty; a null url is an empty target; null identifiers take part as responses
of their own and are revisited by none; rows that repeat an identifier are written each, and of equal payloads under
the greatest identifier each is a response; a record's WARC-Record-ID follows from its identifier and payload, so equal rows share it; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, modest_batches, shared_dir, table, written

LEAST = 1000
FRAME, BUNDLE = 256 << 10, 8 << 20
# Fixed values of the formats: magic numbers of skippable frames and of the seek table's footer.
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Into so many groups the records of one payload are dealt when they learn which of them is the response.
SALTS = 32


def record_id(identifier: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{identifier}:{digest}')}>"


def record(identifier: int | None, target: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record of an HTTP response; a revisit (``refers_to`` given) holds its headers alone. ``digest`` is the payload's SHA-1 in hex."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(identifier, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(target.split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if identifier is None else identifier}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def response(block: bytes) -> tuple[int, bytes]:
    """The payload's length that the headers of an HTTP response tell, and what follows them."""
    stop = block.index(b"\r\n\r\n")
    lines = block[:stop].decode().split("\r\n")
    if not lines[0].startswith("HTTP/"):
        raise ValueError("the block is no HTTP response")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return int(fields["content-length"]), block[stop + 4 :]


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower case), body and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    body = data[stop + 4 : stop + 4 + length]
    if len(body) != length or data[stop + 4 + length : stop + 8 + length] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut short")
    return fields, body, stop + 8 + length


def bundle(frames: list[list[tuple[str, bytes]]], level: int = 3) -> bytes:
    """Frames of (record identifier, record) as one seekable bundle."""
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
    parts, seeks, places = [], [], []
    for number, records in enumerate(frames):
        offset = 0
        for name, data in records:
            places.append([name, number, offset, len(data)])
            offset += len(data)
        packed = compressor.compress(b"".join(data for _, data in records))
        parts.append(packed)
        seeks.append((len(packed), offset))
    index = compressor.compress(json.dumps(places, separators=(",", ":")).encode())
    parts.append(struct.pack("<II", SKIPPABLE_MAP, len(index)) + index)
    seeks.append((len(index) + 8, 0))
    table_ = b"".join(struct.pack("<II", *pair) for pair in seeks) + struct.pack("<IBI", len(seeks), 0, SEEKABLE)
    return b"".join(parts) + struct.pack("<II", SKIPPABLE_SEEK, len(table_)) + table_


class Bundle:
    """Random access to the records of a bundle; ``file`` is a binary file that can be sought in."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.seek(0, 2)
        count, flags, magic = struct.unpack("<IBI", self._bytes(max(0, end - 9), 9))
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError("not a seekable bundle")
        width = 12 if flags & 0x80 else 8
        low = end - 9 - count * width
        table_ = self._bytes(low - 8, 8 + count * width)
        if struct.unpack("<II", table_[:8]) != (SKIPPABLE_SEEK, count * width + 9):
            raise ValueError("the seek table's frame is damaged")
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack("<II", table_[8 + i * width : 16 + i * width])
            self.frames.append((at, packed, plain))
            at += packed
        start, packed, _ = self.frames.pop()
        index = self._bytes(start, packed)
        if struct.unpack("<I", index[:4])[0] != SKIPPABLE_MAP:
            raise ValueError("the record map is missing")
        self.places = [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(index[8:]))]
        self.by_name: dict[str, tuple[int, int, int]] = {}
        for name, *place in self.places:
            self.by_name.setdefault(name, tuple(place))

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(size)
        if len(out) != size:
            raise ValueError("the bundle is cut short")
        return out

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        out = zstandard.ZstdDecompressor().decompress(self._bytes(at, packed), max_output_size=plain) if plain else b""
        if len(out) != plain:
            raise ValueError(f"frame {number} is damaged")
        return out

    def read(self, name: str) -> bytes:
        """The first record under an identifier, from its frame alone."""
        number, offset, length = self.by_name[name]
        return self.frame(number)[offset : offset + length]

    def records(self):
        """All records in order, each frame read once, placed by the record map."""
        open_, data = -1, b""
        for _, number, offset, length in self.places:
            if number != open_:
                open_, data = number, self.frame(number)
            yield data[offset : offset + length]


def decided(df: DataFrame, key: str, payload: str, *, least: int = LEAST) -> DataFrame:
    """The columns of ``df`` in ``row``, with payload_bytes, payload_digest and refers_to (null: a response)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("id"), F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    takes_part = (F.col("payload_bytes") >= least) & F.col("id").isNotNull()
    several = rows.where(takes_part).groupBy("payload_digest").agg(F.max("id").alias("kept"), F.min("id").alias("low")).where("kept != low")
    several = several.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.concat("payload_digest", F.lit(":"), i.cast("string")))).alias("group"), "kept")
    # the records of a frequent payload are dealt to several groups, those without part in it to groups of their own
    group = F.when(takes_part, F.concat("payload_digest", F.lit(":"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("string"))).otherwise(F.coalesce(F.col("id").cast("string"), F.uuid()))
    met = rows.withColumn("group", group).join(several, "group", "left")
    return met.select("row", "payload_bytes", "payload_digest", F.when(F.col("id") != F.col("kept"), F.col("kept")).alias("refers_to"))


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a path or a URI."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def archived(df: DataFrame, key: str, target: str, payload: str, *, date: str = "2024-01-01T00:00:00Z", frame: int = FRAME, size: int = BUNDLE) -> DataFrame:
    """The manifest (path, bytes, records) of the bundles written, with one record per row of ``df``."""
    spark = df.sparkSession
    modest_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = decided(df, key, payload).select(F.col("row")[key].alias("id"), F.coalesce(F.col("row")[target], F.lit("")).alias("target"), F.col("row")[payload].alias("payload"), "payload_digest", "refers_to")

    def run(batches):
        store, path = file_system(folder)
        frames: list[list[tuple[str, bytes]]] = [[]]
        held = total = 0

        def close():
            content = bundle([f for f in frames if f])
            name = f"{uuid.uuid4().hex}.warc.zst"  # another attempt at this task writes other files
            store.create_dir(path)
            with store.open_output_stream(f"{path}/{name}", compression=None) as file:
                file.write(content)
            columns = [pa.array([f"{folder}/{name}"]), pa.array([len(content)], pa.int64()), pa.array([sum(map(len, frames))], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "records"])

        for batch in batches:
            ids, targets, _, digests, refers = (c.to_pylist() for c in batch.columns)
            for i, to, body, digest, refer in zip(ids, targets, as_bytes(batch.column(2)), digests, refers, strict=True):
                data = record(i, to, body, digest, refer, date)
                if held and held + len(data) > frame:
                    frames.append([])
                    held = 0
                frames[-1].append(("" if i is None else str(i), data))
                held += len(data)
                total += len(data)
                if total >= size:
                    yield close()
                    frames, held, total = [[]], 0, 0
        if total:
            yield close()

    return written(rows.mapInArrow(run, "path string, bytes long, records long"), "manifest")


def opened(path: str):
    """A bundle's file, to be sought in; a context manager."""
    folder, _, name = path.rpartition("/")
    store, at = file_system(folder)
    return store.open_input_file(f"{at}/{name}")


def read_record(path: str, identifier: int | None) -> bytes:
    """One record of a bundle's file, by reads of the file's end and of its frame."""
    with opened(path) as file:
        return Bundle(file).read("" if identifier is None else str(identifier))


READ = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType(), False),
    T.StructField("payload_digest", T.StringType(), False),
    T.StructField("record_type", T.StringType(), False),
    T.StructField("refers_to", T.LongType()),
])


def read_archive(manifest: DataFrame) -> DataFrame:
    """One row per record of the bundles that a manifest names; payloads are checked against their digests."""

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with opened(path) as file:
                    for data in Bundle(file).records():
                        fields, block, _ = parsed(data)
                        digest, kind = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), fields["warc-type"]
                        size, payload = response(block)
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
                        rows.append((number(fields["x-page-id"]), size, digest, kind, number(fields.get("x-refers-to-page"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=READ.names)

    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(spread).mapInArrow(run, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(archived(table(spark, sf_dir, "pages"), "page_id", "url", "html"))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p
), k AS (
  SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN k.kept <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.kept <> d.page_id THEN k.kept END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""
