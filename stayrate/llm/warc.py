"""WARC archives: writing, normalising monolithic gzip, and reading by offsets.

An archive is first one gzip stream over all its records. The normaliser
inflates that stream once, front to back, rewrites every record as a gzip member
of its own, and writes a sidecar index of the members' offsets; a reader then
takes single records without inflating what stands before them.

Archives are written by Spark's own text writer, so that they land in any store
Spark reaches and only with a task's commit. It ends each row with a separator;
a zero byte is set as separator and taken off the row, because an archive always
ends with an empty gzip member, whose last four bytes are the length 0.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import few_rows, type_of
from stayrate.session import release, remove, settle, shared_dir

#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 16
GZIP = 16 + zlib.MAX_WBITS
VERSION = b"WARC/1.1"


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; the block's length is added."""
    lines = [VERSION]
    lines += [f"{name}: {value}".encode() for name, value in headers]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Headers by lower-case name."""
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    pairs = (line.decode("utf-8").partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


def inflated(stream: bytes) -> Iterator[bytes]:
    """Content of a gzip file in pieces, whether of one member or of many."""
    view = memoryview(stream)
    unpacker, at = zlib.decompressobj(GZIP), 0
    while True:
        if unpacker.eof:
            at -= len(unpacker.unused_data)
            if at >= len(view):
                return
            unpacker = zlib.decompressobj(GZIP)
        data = unpacker.unconsumed_tail
        if not data:
            data = view[at : at + CHUNK]
            at += len(data)
            if not data:
                break
        piece = unpacker.decompress(data, 4 * CHUNK)
        if piece:
            yield piece
    if rest := unpacker.flush():
        yield rest
    if not unpacker.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of records."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (stop := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's head ends early")
        headers = parse_head(bytes(held[:stop]))
        size = stop + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record ends early")
        yield headers, bytes(held[:size])
        del held[:size]


def normalise(stream: bytes) -> tuple[bytes, list[tuple[int, int, dict[str, str]]]]:
    """The archive with a gzip member per record, and (offset, length, headers) of each."""
    out, index = bytearray(), []
    for headers, whole in records(inflated(stream)):
        member = gzip_member(whole)
        index.append((len(out), len(member), headers))
        out += member
    return bytes(out) + EMPTY_MEMBER, index


def _archives(limit: int) -> Callable:
    """Archives of one gzip stream each, from rows in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        packer, packed, size = None, [], 0

        def archive() -> pa.RecordBatch:
            data = b"".join(packed) + packer.flush() + EMPTY_MEMBER
            return pa.RecordBatch.from_pydict(
                {
                    "archive": pa.array([f"{task:06d}-{number:05d}"]),
                    "data": pa.array([data[:-1]], pa.binary()),
                }
            )

        names = ("row", "id", "uri", "kind", "refers_to", "bytes", "digest", "payload")
        for batch in batches:
            for values in zip(*(batch.column(n) for n in names)):
                row, identity, uri, kind, refers_to, length, digest, payload = (
                    v.as_py() for v in values
                )
                headers = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=row)}>"),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("X-Payload-Length", str(length)),
                ]
                for name, value in (
                    ("X-Page-Id", identity),
                    ("WARC-Target-URI", uri),
                    ("X-Refers-To-Page-Id", refers_to),
                ):
                    if value is not None:
                        headers.append((name, " ".join(str(value).split())))
                whole = record(headers, payload if kind == "response" else b"")
                packer = packer or zlib.compressobj(6, zlib.DEFLATED, GZIP)
                packed.append(packer.compress(whole))
                size += len(whole)
                if size >= limit:
                    yield archive()
                    packer, packed, size, number = None, [], 0, number + 1
        if packer is not None:
            yield archive()

    return run


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch.column("archive"), batch.column("content")):
            data, index = normalise(content.as_py())
            lines = "\n".join(
                f"{start}\t{size}\t{h['warc-record-id']}\t{h['warc-type']}\t{h['warc-payload-digest']}"
                for start, size, h in index
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "archive": pa.array([archive.as_py()] * 2),
                    "kind": pa.array(["warc", "index"]),
                    "data": pa.array([data[:-1], lines.encode()], pa.binary()),
                }
            )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by the offsets of the sidecar index."""
    for batch in batches:
        for content, lines in zip(batch.column("content"), batch.column("lines")):
            data, out = content.as_py(), []
            for line in lines.as_py().split("\n"):
                start, size, identity, kind, digest = line.split("\t")
                whole = zlib.decompress(data[int(start) : int(start) + int(size)], GZIP)
                head, _, block = whole.partition(b"\r\n\r\n")
                headers = parse_head(head)
                payload = block[: int(headers["content-length"])]
                length = int(headers["x-payload-length"])
                if headers["warc-record-id"] != identity or headers["warc-type"] != kind:
                    raise ValueError(f"the index does not match record {identity}")
                if kind == "response" and (
                    f"sha1:{payload_digest(payload)}" != digest or len(payload) != length
                ):
                    raise ValueError(f"payload of record {identity} is damaged")
                out.append(
                    {
                        "id": headers.get("x-page-id"),
                        "uri": headers.get("warc-target-uri"),
                        "payload_bytes": length,
                        "payload_digest": digest.removeprefix("sha1:"),
                        "record_type": kind,
                        "refers_to": headers.get("x-refers-to-page-id"),
                        "payload": payload if kind == "response" else None,
                    }
                )
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=READ_SCHEMA)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=READ_SCHEMA)


READ_SCHEMA = pa.schema(
    [
        ("id", pa.string()),
        ("uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [p.as_py() for p in batch.column("payload")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in ("id", "uri", "payload")),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([payload_digest(p) for p in payloads], pa.string()),
                pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
            ],
            names=["id", "uri", "payload", "bytes", "digest", "content"],
        )


def planned_records(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """One row per page with what its record holds, and the written table it reads.

    Payloads of revisits are left out.

    The row that stays of a group of equal payloads is found from hashes, ids
    and row numbers alone; a group's payloads never meet in one task. Payloads are
    equal by length and SHA-256: SHA-1, which the records carry, has known collisions.
    """
    kind = type_of(pages, id_col)
    rows = settle(
        pages.select(
            F.col(id_col).alias("id"),
            F.col(url_col).cast("string").alias("uri"),
            F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        )
        .mapInArrow(
            _digests,
            f"id {kind}, uri string, payload binary, bytes long, digest string, content binary",
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    # Nulls come before all ids; of rows with one id the first stays.
    best = F.max(F.struct(F.col("id"), (-F.col("row")).alias("back"))).alias("best")
    groups = rows.where(F.col("bytes") >= revisit_bytes).groupBy("content", "bytes").agg(best)
    facts = groups.select(
        "content",
        "bytes",
        F.col("best.id").alias("first_id"),
        (-F.col("best.back")).alias("first_row"),
    )
    revisits = (
        rows.select("row", "content", "bytes")
        .join(facts, ["content", "bytes"])
        .where("row != first_row")
        .select("row", F.col("first_id").alias("refers_to"), F.lit("revisit").alias("kind"))
    )
    marked = rows.join(few_rows(settle(revisits)), "row", "left").withColumn(
        "kind", F.coalesce("kind", F.lit("response"))
    )
    payload = F.when(F.col("kind") == "response", F.col("payload"))
    return marked.withColumn("payload", payload), rows


def write_archives(planned: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives ``path/archive=<name>/``, each one gzip stream of many records."""
    spread = planned.select(
        "row",
        F.col("id").cast("string").alias("id"),
        "uri",
        "kind",
        F.col("refers_to").cast("string").alias("refers_to"),
        "bytes",
        "digest",
        "payload",
    )
    _write_raw(
        spread.mapInArrow(_archives(archive_bytes), "archive string, data binary"),
        path,
        ["archive"],
    )


def _write_raw(rows: DataFrame, path: str, folders: list[str]) -> None:
    rows.select(*folders, F.col("data").cast("string").alias("value")).write.partitionBy(
        *folders
    ).option("lineSep", "\x00").text(path)


def _files(df: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"archive=([0-9]+-[0-9]+)", 1)
    return df.select(name.alias("archive"), "content")


def normalise_archives(spark, path: str, out: str) -> None:
    """Rewrites every archive under ``path`` with a member per record, and an index.

    ``out/archive=<name>/kind=warc`` holds the archive, ``kind=index`` its
    sidecar: offset, length, record id, type and digest of every record.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    _write_raw(
        _files(found).mapInArrow(_normaliser, "archive string, kind string, data binary"),
        out,
        ["archive", "kind"],
    )


def read_archives(spark, path: str) -> DataFrame:
    """The records of normalised archives, each read by its offset."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    archives = _files(found.where(F.col("path").contains("/kind=warc/")))
    indexes = _files(found.where(F.col("path").contains("/kind=index/"))).select(
        "archive", F.col("content").cast("string").alias("text")
    )
    lines = F.expr("substring(text, 1, length(text) - 1)")  # without the separator
    indexes = few_rows(indexes.select("archive", lines.alias("lines")))
    both = archives.join(indexes, "archive").select("content", "lines")
    return both.mapInArrow(
        _reader,
        "id string, uri string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to string, payload binary",
    )


def archive_round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes pages as WARC archives, normalises them, and reads every record back.

    One row per page: id, ``uri``, ``payload_bytes``, ``payload_digest`` (base32
    SHA-1), ``record_type``, ``refers_to`` and, for responses, ``payload``. Of
    pages with equal payloads of at least ``revisit_bytes`` the one with the
    largest id is the response, the others revisit it. A null payload counts as
    empty, a null id comes before all others, and of rows with one id exactly
    one is the response. White space in a URL is written as single spaces. An
    empty table gives no rows; other columns are not read.
    """
    spark, kind = pages.sparkSession, type_of(pages, id_col)
    planned, rows = planned_records(pages, id_col, url_col, payload_col, revisit_bytes)
    base = shared_dir(spark)
    write_archives(planned, f"{base}/monolithic", archive_bytes)
    release(rows)
    normalise_archives(spark, f"{base}/monolithic", f"{base}/normalised")
    remove(spark, f"{base}/monolithic")
    return read_archives(spark, f"{base}/normalised").select(
        F.col("id").cast(kind).alias(id_col),
        "uri",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "payload",
    )
