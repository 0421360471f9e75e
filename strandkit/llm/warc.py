"""Web archives in seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES`` that decompress on their own,
frames into bundle files.  A bundle ends in a seek table (a skippable frame with the
sizes of all frames, as the public seekable format lays it out).  The index maps each
record to its bundle, frame and place inside the frame; a reader fetches the table from
the end of a bundle, and then only the frames it needs.

Of records with equal payloads the one with the largest id is the response and the
others revisit it: they carry the headers and the digest, and no payload.  Equal
payloads are found on narrow (id, digest) rows, where one payload may hold any share of
the rows; the pages themselves move by (id, digest).

Bundles are written under the session's shared checkpoint folder, through pyarrow's
file systems.  Each task attempt writes files of its own and hands out index rows only
when they are closed, so a lost executor leaves at most files that no index names.

A null page has an empty payload, a null url no target header; records without an id
are always responses; rows repeated with one id and payload have one record type;
an empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import prepare
from strandkit.session import checkpoint_folder, reliable_checkpoint

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
WARC_DATE = "2024-01-01T00:00:00Z"

# -- fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<II")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", url and "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("WARC-Profile", refers_to is not None and PROFILE), ("WARC-Refers-To", refers_to is not None and f"<urn:page:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Writes one bundle: frames, then the seek table."""

    def __init__(self, stream):
        self.stream = stream
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.open = bytearray()
        self.packed_bytes = 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the frame and length of the record."""
        if self.open and len(self.open) + len(raw) > FRAME_BYTES:
            self._end_frame()
        place = (len(self.frames), len(self.open), len(raw))
        self.open += raw
        return place

    def _end_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.stream.write(packed)
        self.frames.append((len(packed), len(self.open)))
        self.packed_bytes += len(packed)
        self.open = bytearray()

    def close(self) -> None:
        if self.open:
            self._end_frame()
        table = b"".join(_ENTRY.pack(*f) for f in self.frames)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + _FOOTER.size))
        self.stream.write(table + _FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC))
        self.stream.close()


def seek_table(source) -> list[tuple[int, int]]:
    """(offset, packed size) of each frame, read from the end of a bundle."""
    size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, io.SEEK_END)
    source.seek(size - _FOOTER.size)
    count, _, magic = _FOOTER.unpack(source.read(_FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - _FOOTER.size - count * _ENTRY.size)
    offset, out = 0, []
    for packed, _ in _ENTRY.iter_unpack(source.read(count * _ENTRY.size)):
        out.append((offset, packed))
        offset += packed
    return out


def read_frame(source, place: tuple[int, int]) -> bytes:
    source.seek(place[0])
    return zstandard.ZstdDecompressor().decompress(source.read(place[1]))


@lru_cache(maxsize=8)
def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _folder_uri(spark) -> str:
    folder = checkpoint_folder(spark)
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder[len("file:/") :].lstrip("/")
    return folder if "://" in folder else "file://" + folder


INDEX = "record_id string, bundle string, frame int, offset long, length long"


def write(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives every page; returns the written index (page_id, record_id, bundle, frame,
    offset, length).  Payloads below ``min_bytes`` are always kept as responses."""
    spark = prepare(pages.sparkSession)
    slim = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), F.coalesce(page, F.lit("")).alias("html"))
    keyed = slim.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = keyed.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    last = keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = keys.join(last, "digest").filter("page_id < last").distinct()
    kind = slim.schema["page_id"].dataType
    placed = keyed.join(revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", "last", F.col("html")
    )
    base = f"{_folder_uri(spark)}/bundles-{uuid.uuid4().hex}"
    id_type = _arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(base)
        bundle, name, index = None, "", []

        def finish() -> pa.RecordBatch:
            bundle.close()
            columns = list(zip(*index))
            types = [id_type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "record_id", "bundle", "frame", "offset", "length"]
            )

        for batch in batches:
            for page_id, target, last_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    system.create_dir(root, recursive=True)
                    bundle, index = Bundle(system.open_output_stream(f"{root}/{name}", compression=None)), []
                place = bundle.add(record(page_id, target, text.encode(), last_id))
                index.append((page_id, f"<urn:page:{page_id}>", f"{base}/{name}", *place))
                if bundle.packed_bytes >= BUNDLE_BYTES:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    schema = T.StructType([T.StructField("page_id", kind), *T._parse_datatype_string(INDEX).fields])
    return reliable_checkpoint(placed.mapInArrow(rows, schema))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read(index: DataFrame) -> DataFrame:
    """Reads the records of an index back: (page_id, payload, payload_bytes,
    payload_digest, record_type, refers_to).  The payload of a revisit is null; its size
    and digest come from its headers."""
    prepare(index.sparkSession)
    kind = index.schema["page_id"].dataType
    # index rows are small and stand for large reads: a fixed width, so that they are not put together by size
    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = index.repartition(width, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source, table, frame = None, None, [], b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at is None or at[0] != row["bundle"]:
                    system, path = pafs.FileSystem.from_uri(row["bundle"])
                    if source is not None:
                        source.close()
                    source = system.open_input_file(path)
                    table, at = seek_table(source), (row["bundle"], None)
                if at[1] != row["frame"]:
                    frame, at = read_frame(source, table[row["frame"]]), (row["bundle"], row["frame"])
                fields, http, payload = parse(frame[row["offset"] : row["offset"] + row["length"]])
                if fields["WARC-Record-ID"] != row["record_id"]:
                    raise ValueError(f"the index points to a wrong record: {row}")
                if fields["WARC-Type"] == "revisit":
                    refers = fields["WARC-Refers-To"][len("<urn:page:") : -1]
                    out.append((row["page_id"], None, int(http["Content-Length"]), fields["WARC-Payload-Digest"][5:], "revisit", refers))
                else:
                    out.append((row["page_id"], payload, len(payload), payload_digest(payload), "response", None))
            types = [to_kind, pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    to_kind = _arrow_type(kind)
    schema = T.StructType([
        T.StructField("page_id", kind), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()),
    ])
    return placed.mapInArrow(rows, schema).withColumn("refers_to", F.col("refers_to").cast(kind))
