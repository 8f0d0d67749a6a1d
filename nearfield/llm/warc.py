"""WARC archives of pages: written as whole-file gzip, normalised to a member for each record.

An archive is a row (archive, octets), so that any store Spark reads can hold it;
``save_files`` and ``load_files`` exchange such rows with .warc.gz files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Batches, stored

# An archive ends with the record that brings it to so many bytes before compression.
ARCHIVE_BYTES = 8 << 20
LEVEL = 5
INFLATE_BYTES = 1 << 18
GZIP = 31
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD, REFERS_FIELD, SIZE_FIELD = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Bytes"

ARCHIVES = "archive string, octets binary"
INDEX = "array<struct<page_id: bigint, record_type: string, offset: bigint, length: bigint>>"
RECORDS = (
    "archive string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to for each distinct (page_id, payload digest in hex).

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the greatest id
    is the response and the others refer to it; smaller payloads refer to none. Only ids and
    digests are shuffled, and equal digests are reduced before that.
    """
    octets = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(octets).alias("digest"), F.octet_length(octets).alias("n"))
    narrow = stored(narrow.distinct())
    latest = narrow.groupBy("digest").agg(F.max("page_id").alias("latest"))
    older = (F.col("n") >= min_bytes) & F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return narrow.join(latest, "digest").select("page_id", "digest", F.when(older, F.col("latest")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}').urn}>"
    line = lambda text: " ".join(text.split())
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", line(url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + payload_digest(payload)))
    if revisit:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE), (REFERS_FIELD, str(refers_to))]
    if page_id is not None:
        fields.append((PAGE_FIELD, str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields += [(SIZE_FIELD, str(len(payload))), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, octets): the pages' records, each archive one gzip stream over all of its records.

    ``pages`` has page_id, url, html; a null html is an empty payload, a null url gives no
    target, other columns are left out. Repeated rows write a record each. Each task fills
    archives in turn and holds one at a time.
    """
    octets = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", octets.alias("payload"), F.sha1(octets).alias("digest"))
    types = record_types(pages, min_bytes).toDF("its_id", "its_digest", "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest"))
    typed = rows.join(types, same).select("page_id", "url", "payload", "refers_to")

    def write(batches: Batches) -> Batches:
        part, made, packer, parts, size = TaskContext.get().partitionId(), 0, None, [], 0

        def finished() -> pa.RecordBatch:
            name = f"part-{part:06d}-{made:04d}.warc.gz"
            return pa.RecordBatch.from_pydict({"archive": [name], "octets": [b"".join([*parts, packer.flush()])]})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                if packer is None:
                    packer, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0
                record = _record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                parts.append(packer.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield finished()
                    packer, made = None, made + 1
        if packer is not None:
            yield finished()

    return stored(typed.mapInArrow(write, ARCHIVES))


def _inflated(octets: bytes) -> Iterator[bytes]:
    """What the gzip members of an archive hold, in pieces of bounded size."""
    while octets:
        stream = zlib.decompressobj(GZIP)
        while not stream.eof:
            piece = stream.decompress(octets, INFLATE_BYTES)
            octets = stream.unconsumed_tail
            if not piece and not octets and not stream.eof:
                raise ValueError("the archive ends within a gzip member")
            yield piece
        octets = stream.unused_data


def _records(octets: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, block, whole record) of each record, from one pass over the stream."""
    held = bytearray()
    pieces = _inflated(octets)

    def until(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while until(lambda: held):
        if not until(lambda: b"\r\n\r\n" in held) or not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        top = held.index(b"\r\n\r\n") + 4
        lines = held[: top - 4].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["Content-Length"])
        if not until(lambda: len(held) >= top + size + 4):
            raise ValueError("the archive ends within a record")
        yield fields, bytes(held[top : top + size]), bytes(held[: top + size + 4])
        del held[: top + size + 4]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, octets, records): every record its own gzip member, and where each one lies.

    An archive's stream is inflated once, a record at a time. ``records`` is its index, in
    the order of the archive: page_id, record_type, offset and length of the member.
    """

    def rewrite(batches: Batches) -> Batches:
        for batch in batches:
            for archive, octets in zip(batch.column(0), batch.column(1)):
                out, index, at = [], [], 0
                for fields, _, whole in _records(octets.as_py()):
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    member = packer.compress(whole) + packer.flush()
                    index.append((_number(fields.get(PAGE_FIELD)), fields["WARC-Type"], at, len(member)))
                    out.append(member)
                    at += len(member)
                keys = ("page_id", "record_type", "offset", "length")
                kind = pa.list_(pa.struct([("page_id", pa.int64()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
                rows = pa.array([[dict(zip(keys, r)) for r in index]], kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive.as_py()]), pa.array([b"".join(out)], pa.binary()), rows], names=["archive", "octets", "records"]
                )

    return stored(archives.select("archive", "octets").mapInArrow(rewrite, f"{ARCHIVES}, records {INDEX}"))


def sidecar(normalised: DataFrame) -> DataFrame:
    """archive, page_id, record_type, offset, length: the index, a row for each record."""
    return normalised.select("archive", F.explode("records").alias("r")).select("archive", "r.*")


def read_records(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """The records, each inflated alone from where the index says it lies.

    A response's digest must be that of its payload, else the read fails; a revisit has the
    digest and size of the payload it refers to and no payload of its own.
    """

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for archive, octets, records in zip(*(batch.column(i) for i in range(3))):
                whole, rows = memoryview(octets.as_buffer()), []
                for place in records.as_py():
                    member = zlib.decompress(whole[place["offset"] : place["offset"] + place["length"]], GZIP)
                    fields, block, _ = next(_records_of(member))
                    revisit = fields["WARC-Type"] == "revisit"
                    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and (payload_digest(payload) != digest or len(payload) != int(fields[SIZE_FIELD])):
                        raise ValueError(f"damaged record at {place['offset']} of {archive}")
                    rows.append((archive.as_py(), _number(fields.get(PAGE_FIELD)), fields.get("WARC-Target-URI"), int(fields[SIZE_FIELD]),
                                 digest, fields["WARC-Type"], _number(fields.get(REFERS_FIELD)), payload if payloads else None))
                names = [c.split()[0] for c in RECORDS.split(", ")]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return normalised.select("archive", "octets", "records").mapInArrow(read, RECORDS)


def _records_of(member: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The one record of an inflated member."""
    top = member.index(b"\r\n\r\n") + 4
    lines = member[: top - 4].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
    yield fields, member[top : top + int(fields["Content-Length"])], member


def save_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of a folder that all executors mount; (archive, bytes) written."""

    def save(batches: Batches) -> Batches:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for archive, octets in zip(batch.column(0), batch.column(1)):
                path = os.path.join(folder, archive.as_py())
                # A task that runs twice replaces the file by an equal one.
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(octets.as_py())
                os.replace(f.name, path)
                yield pa.RecordBatch.from_pydict({"archive": [archive.as_py()], "bytes": [len(octets.as_py())]})

    return archives.select("archive", "octets").mapInArrow(save, "archive string, bytes bigint")


def load_files(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, octets) of the .warc.gz files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("octets"))
