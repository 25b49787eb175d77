"""WARC archives in Zstandard frames: one frame per record, the dictionary in the leading frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of its other
frames; each record is a frame of its own, so that a reader can decode any record alone. Archives
are written by Spark's own text sink: a row is the bytes of one frame, and the line separator is
an empty skippable frame, which readers of the format pass over. They so go to whatever file
system the path names, under Spark's commit protocol, and are read back with its binary reader.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import shared_folder, staged

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; its eight bytes are also ASCII characters.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_ID = "<urn:page:{}>"
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 16 << 10
REVISIT_LEAST = 100
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, payload binary, archive string"
)


class ArchiveError(ValueError):
    """A frame, header or length that doesn't hold."""


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC record; a revisit has the HTTP head alone as its block."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {RECORD_ID.format(refers_to)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of one archive: the dictionary, trained on the first records, then one per record."""
    import zstandard

    def rows():
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                yield record(r[0], r[1], r[2] or b"", r[3], r[4], r[5])

    source, first, size = rows(), [], 0
    for data in source:
        first.append(data)
        size += len(data)
        if size >= SAMPLE_BYTES:
            break
    if not first:
        return
    out = []
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [d[: 64 << 10] for d in first])
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(trained.as_bytes())) + trained.as_bytes())
        packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    except zstandard.ZstdError:  # too few records to train on: frames without a dictionary
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    held = 0
    for part in (first, source):
        for data in part:
            out.append(packer.compress(data))
            held += len(out[-1])
            if held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives below ``path``.

    Of rows with equal payloads of at least ``REVISIT_LEAST`` bytes, those with the smallest
    page_id are responses and the others revisit it; smaller payloads are all responses, and so
    is a payload whose rows have no page_id at all. A null html is the empty payload, a null url
    is left out. Only ids and digests are shuffled to find equal payloads; html moves once at most,
    in the join by page_id, each of whose tasks writes one archive, and a payload that is
    revisited isn't written again.
    """
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    digested = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    digests = staged(digested.select("page_id", "n_bytes", "digest"))
    repeated = (
        digests.filter(F.col("n_bytes") >= REVISIT_LEAST).groupBy("digest", "n_bytes")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    )
    revisits = (
        digests.filter(F.col("n_bytes") >= REVISIT_LEAST).join(repeated, ["digest", "n_bytes"])
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "refers_to").distinct()
    )
    joined = digested.join(
        revisits, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left"
    )
    records = joined.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("payload"), "n_bytes", "digest", "refers_to"
    )
    frames = records.mapInArrow(_frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR).text(path)


def frame_end(data: memoryview, start: int) -> int:
    """Where the frame that begins at ``start`` ends, from its header and block sizes."""
    if len(data) - start < 8:
        raise ArchiveError(f"cut off at byte {start}")
    magic = struct.unpack_from("<I", data, start)[0]
    if magic in SKIPPABLE:
        end = start + 8 + struct.unpack_from("<I", data, start + 4)[0]
    elif magic == FRAME_MAGIC:
        flags = data[start + 4]
        single = flags >> 5 & 1
        at = start + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            if at + 3 > len(data):
                raise ArchiveError(f"cut off at byte {at}")
            head = int.from_bytes(data[at : at + 3], "little")
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        end = at + 4 * (flags >> 2 & 1)
    else:
        raise ArchiveError(f"no frame at byte {start}")
    if end > len(data):
        raise ArchiveError(f"cut off at byte {len(data)}")
    return end


def frames_of(data: memoryview) -> Iterator[bytes]:
    """Decoded records of an archive, one for each frame."""
    import zstandard

    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        end = frame_end(data, at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = bytes(data[8:end])
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the format allows a packed dictionary
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic not in SKIPPABLE:
            try:
                one = reader.decompressobj()
                yield one.decompress(data[at:end])
            except zstandard.ZstdError as err:
                raise ArchiveError(f"frame at byte {at}: {err}") from err
        at = end


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises ``ArchiveError`` where something doesn't hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ArchiveError(f"bad or repeated header: {line[:80]}")
        headers[name.lower()] = value.strip()
    try:
        kind, length = headers["warc-type"], int(headers["content-length"])
        page, digest = headers["warc-record-id"], headers["warc-payload-digest"].removeprefix("sha256:")
        n_bytes = int(headers["x-payload-length"])
    except (KeyError, ValueError) as err:
        raise ArchiveError(f"header missing or not a number: {err}") from err
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {length} doesn't fit a block of {len(rest) - 4} bytes")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ArchiveError("the block is no HTTP message")
    number = re.compile(r"<urn:page:(-?\d*)>")
    ids = [number.fullmatch(x) for x in (page, headers.get("warc-refers-to", "<urn:page:>"))]
    if None in ids or kind not in ("response", "revisit") or (kind == "revisit") != bool(ids[1][1]):
        raise ArchiveError(f"bad record type or id: {kind} {page}")
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError(f"payload of {page} has not the length or digest it should")
    return {
        "page_id": int(ids[0][1]) if ids[0][1] else None, "payload_bytes": n_bytes, "payload_digest": digest,
        "record_type": kind, "refers_to": int(ids[1][1]) if ids[1][1] else None,
        "url": headers.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``, as ``RECORD_SCHEMA``.

    Every frame is decoded alone with its archive's dictionary and validated: version line,
    headers, Content-Length, record type and ids, and, for responses, payload length and SHA-256.
    A revisit's length and digest are those its header gives of the payload it refers to. An
    archive that is cut off or damaged fails the read with its name and the byte.
    """
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                try:
                    for data in frames_of(memoryview(content.as_buffer())):
                        row = parse_record(data) | {"archive": archive.as_py()}
                        size += len(data) if payloads else 500
                        rows.append(row if payloads else row | {"payload": None})
                        if size >= 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                except ArchiveError as err:
                    raise ArchiveError(f"{archive.as_py()}: {err}") from err
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def broken_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, n) of revisits whose response isn't there with that digest.

    Revisits are counted by what they refer to before the join, so that a payload which a third
    of all records revisit is one row.
    """
    wanted = records.filter("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(
        F.count(F.lit(1)).alias("n")
    )
    there = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes"
    )
    return wanted.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without payloads."""
    path = shared_folder(pages.sparkSession) + "/archives"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payloads=False)
