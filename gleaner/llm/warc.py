"""WARC archives in seekable Zstandard bundles, written and read by tasks.

Records are grouped into frames that are compressed each for itself; a bundle ends in a seek table (the public "seekable
format": a skippable frame with the compressed and raw size of every frame), so that any frame can be found from the end of
the file and read alone. An index maps record identifiers to bundle, frame and the offset within the raw frame.

Of pages with equal payloads the one with the smallest id is a response, the others are revisits that refer to it. Only
digests are grouped. A task writes bundles under names of its own; the index, committed by Spark, names those of the tasks
that count, so lost or repeated tasks leave unused files at worst.

Defined results: null payloads count as empty; a null id never is what others refer to, so equal payloads that have null
ids only are all responses; rows that repeat the smallest id are all responses; an empty table gives an archive without
bundles. Columns other than the id, the address and the payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import PIECE_BYTES, as_bytes, pieces, stored

FRAME_BYTES = 1 << 19
BUNDLE_BYTES = 1 << 30
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Distinct repeated digests up to which every writing task gets them all: about 60 bytes each.
BROADCAST_ROWS = 200_000

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "record_id string, bundle string, frame long, offset long, length long"
FRAME_SCHEMA = "bundle string, frame long, at long, size long, raw_size long"
RECORD_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
                 "payload_bytes long, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the headers of the answer but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` of a raw frame, and where the next one begins."""
    head = raw.index(b"\r\n\r\n", start)
    first, *lines = raw[start:head].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = dict(line.split(": ", 1) for line in lines)
    end = head + 4 + int(fields["Content-Length"])
    body = raw.index(b"\r\n\r\n", head + 4) + 4
    identity = lambda value: value and value.removeprefix("<urn:page:").removesuffix(">")
    out = {"record_id": identity(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "target_uri": fields.get("WARC-Target-URI"),
           "refers_to": identity(fields.get("WARC-Refers-To")), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
           "payload_bytes": None, "payload": None}
    if out["record_type"] == "response":
        payload = raw[body:end]
        if base32_sha1(payload) != out["payload_digest"]:
            raise ValueError(f"record {out['record_id']} does not have the payload that its digest names")
        out |= {"payload": payload, "payload_bytes": len(payload)}
    return out, end + 4


class Bundle:
    """A file of frames that ends in a seek table."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, path = pa.fs.FileSystem.from_uri(self.name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)  # the name would have it compressed again
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.written = 0

    def add(self, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.sizes.append((len(frame), len(raw)))
        self.written += len(frame)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(bundle: str) -> list[tuple[int, int, int]]:
    """Place, size and raw size of every frame, from the end of the file."""
    files, path = pa.fs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as source:
        end = source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{bundle} does not end in a seek table")
        out, at = [], 0
        for size, raw in struct.iter_unpack("<II", source.read_at(8 * n, end - 9 - 8 * n)):
            out.append((at, size, raw))
            at += size
    return out


@dataclass(frozen=True)
class Archive:
    folder: str
    index: DataFrame


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> Archive:
    """Write a record per row. Payloads of fewer than ``min_bytes`` are responses always."""
    html = F.coalesce(F.col(payload_column), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page"), F.col(url_column).cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    repeated = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.filter("n > 1 and first is not null").select("digest", "first"), "digests")
    few = repeated.count() <= BROADCAST_ROWS
    named = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left").select(
        F.coalesce(F.col("page").cast("string"), F.concat(F.lit("none-"), F.substring("digest", 1, 16))).alias("page"), "url", "payload",
        F.when((F.col("first") != F.col("page")) | F.col("page").isNull(), F.col("first")).cast("string").alias("refers_to"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle: Bundle | None = None
        raw, index = bytearray(), []

        def flush(bundle: Bundle | None) -> Bundle:
            bundle = bundle or Bundle(folder)
            bundle.add(bytes(raw))
            raw.clear()
            return bundle

        def entries(bundle: Bundle) -> pa.RecordBatch:
            at = len(bundle.sizes) - 1
            ids, offsets, lengths = zip(*index)
            index.clear()
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([bundle.name] * n), pa.array([at] * n), pa.array(offsets), pa.array(lengths)],
                                              names=["record_id", "bundle", "frame", "offset", "length"])

        for batch in pieces(batches, "payload"):
            for page, url, payload, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)).to_pylist(), batch.column(3).to_pylist()):
                one = record(page, url, payload, refers)
                index.append((page, len(raw), len(one)))
                raw += one
                if len(raw) >= frame_bytes:
                    bundle = flush(bundle)
                    yield entries(bundle)
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if raw:
            bundle = flush(bundle)
            yield entries(bundle)
        if bundle:
            bundle.close()

    return Archive(folder, stored(named.mapInArrow(task, INDEX_SCHEMA), "warc-index"))


def frames(archive: Archive) -> DataFrame:
    """Every frame of the archive, as its bundles' seek tables tell."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                at, size, raw = zip(*seek_table(bundle))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * n), pa.array(range(n)), pa.array(at), pa.array(size), pa.array(raw)],
                                                 names=["bundle", "frame", "at", "size", "raw_size"])

    return archive.index.select("bundle").distinct().mapInArrow(task, FRAME_SCHEMA)


def _batch(records: list[dict]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], k) for n, k in zip(names, kinds)], names=names)


def _raw_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    unpacker, name, source = zstandard.ZstdDecompressor(), None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bundle"] != name:
                if source:
                    source.close()
                files, path = pa.fs.FileSystem.from_uri(name := row["bundle"])
                source = files.open_input_file(path)
            yield row, unpacker.decompress(source.read_at(row["size"], row["at"]))
    if source:
        source.close()


def read_archive(archive: Archive) -> DataFrame:
    """All records, read from the bundles a frame at a time. Revisits have no payload of their own."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in _raw_frames(batches):
            at, held, size = 0, [], 0
            while at < len(raw):
                one, after = parse(raw, at)
                held.append(one)
                size += after - at
                at = after
                if size >= PIECE_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return frames(archive).repartition("bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(task, RECORD_SCHEMA)


def fetch(archive: Archive, record_ids: DataFrame) -> DataFrame:
    """The records of ``record_ids (record_id)``: only frames that hold one are opened, each once."""
    wanted = archive.index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
    rows = places.join(frames(archive), ["bundle", "frame"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, raw in _raw_frames(batches):
            yield _batch([parse(raw, at)[0] for at in sorted(row["offsets"])])

    return rows.mapInArrow(task, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records without payloads; revisits have the payload's size from the response they refer to."""
    narrow = records.drop("payload")
    sizes = narrow.filter("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.max("payload_bytes").alias("of_bytes"))
    return narrow.join(sizes, F.col("refers_to") == F.col("of"), "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "of_bytes")).drop("of", "of_bytes")


def round_trip(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write an archive and tell what it holds: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[options.get("id_column", "page_id")].dataType.simpleString()
    back = resolved(read_archive(write_archive(pages, folder, **options)))
    page = F.when(~F.col("record_id").startswith("none-"), F.col("record_id")).cast(kind)
    return back.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

