"""WARC archives: writing, normalising whole-file gzip to one member a record with a sidecar index, reading by index."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, saved, table
from tidemark.session import shared_folder

ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
RECORD_TYPES = ("response", "revisit")
# Names and profile of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (local, S3, GCS, HDFS by its URI) and the path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, kind: str) -> bytes:
    """One record; a revisit has no body but the digest and length of what it repeats."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id), "WARC-Date": "1970-01-01T00:00:00Z"}
    if url:
        head["WARC-Target-URI"] = " ".join(url.split())
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    head["WARC-Payload-Digest"] = f"sha1:{sha1}"
    body = payload
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
        head["X-Payload-Length"] = str(len(payload))
        body = b""
    head |= {"Content-Type": "text/html", "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return VERSION + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parsed_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and whole raw records of an inflated stream; holds one record at a time."""
    buffer = bytearray()
    more = True
    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0 and more:
            seen = max(0, len(buffer) - 3)
            chunk = next(stream, None)
            more = chunk is not None
            buffer += chunk or b""
            end = buffer.find(b"\r\n\r\n", seen)
        if end < 0:
            if buffer.strip():
                raise ValueError("the archive ends within a record")
            return
        head = parsed_head(bytes(buffer[:end]))
        size = end + 4 + int(head["Content-Length"]) + 4
        while len(buffer) < size:
            chunk = next(stream, None)
            if chunk is None:
                raise ValueError("the archive ends within a record")
            buffer += chunk
        yield head, bytes(buffer[:size])
        del buffer[:size]


def inflated(source: io.RawIOBase) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in bounded chunks, each byte inflated once."""
    inflate = zlib.decompressobj(GZIP)
    data = source.read(CHUNK)
    while data:
        out = inflate.decompress(data, CHUNK)
        if out:
            yield out
        if inflate.eof:
            data, inflate = inflate.unused_data, zlib.decompressobj(GZIP)
        else:
            data = inflate.unconsumed_tail
        if not data:
            data = source.read(CHUNK)


def write_archives(records_of: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, sha1, refers_to, record_type) as archives, one gzip stream a file.

    Returns the ``archive`` paths. A task writes a new file after
    ``archive_bytes`` of records, under names that no other attempt uses; only
    the files that finished tasks return count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = store(folder)
        files.create_dir(base)
        prefix = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        names: list[str] = []
        out = None

        def finish() -> None:
            out.write(deflate.flush())
            out.close()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{prefix}-{len(names):05d}.warc.gz")
                    out = files.open_output_stream(names[-1], compression=None)
                    deflate, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
                sha1 = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                raw = record(row["page_id"], row["url"], row["payload"], sha1, row["refers_to"], row["record_type"])
                out.write(deflate.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string())})

    return records_of.mapInArrow(write, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives that are one gzip stream, so that every record is a member of its own.

    The stream is inflated once, in bounded chunks; each record is deflated
    alone and its place noted. Beside each new file lies ``<name>.idx`` with one
    JSON line a record: ``offset, length, type, page_id``. Returns the index,
    with the ``archive``. Each archive is one row, so tasks share the files.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        files.create_dir(base)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                name = f"{base}/{path.rsplit('/', 1)[-1]}"
                own = f"{name}.{uuid.uuid4().hex}"
                lines, offset = [], 0
                with files.open_input_stream(path, compression=None) as source, files.open_output_stream(own, compression=None) as out:
                    for head, raw in records(inflated(source)):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = deflate.compress(raw) + deflate.flush()
                        out.write(member)
                        page = head.get("X-Page-ID")
                        lines.append((offset, len(member), head["WARC-Type"], int(page) if page else None))
                        offset += len(member)
                with files.open_output_stream(f"{own}.idx", compression=None) as index:
                    for line in lines:
                        index.write((json.dumps(dict(zip(("offset", "length", "type", "page_id"), line))) + "\n").encode())
                files.move(f"{own}.idx", f"{name}.idx")
                files.move(own, name)
                offsets, lengths, kinds, pages = zip(*lines) if lines else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kinds, pa.string()), pa.array(pages, pa.int64())],
                    ["archive", "offset", "length", "type", "page_id"],
                )

    return archives.mapInArrow(rewrite, "archive string, offset long, length long, type string, page_id long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads the members at (archive, offset, length): ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    A payload's length and digest are computed from what is read; a revisit has
    them from its head, and no payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(folder)
        path, source = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["archive"] != path:
                    path, source = row["archive"], files.open_input_file(row["archive"])
                source.seek(row["offset"])
                raw = zlib.decompress(source.read(row["length"]), GZIP)
                end = raw.index(b"\r\n\r\n")
                head = parsed_head(raw[:end])
                payload = raw[end + 4 : end + 4 + int(head["Content-Length"])]
                again = head["WARC-Type"] == "revisit"
                page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                rows.append({
                    "page_id": int(page) if page else None,
                    "url": head.get("WARC-Target-URI"),
                    "payload": None if again else payload,
                    "payload_bytes": int(head["X-Payload-Length"]) if again else len(payload),
                    "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest(payload),
                    "record_type": head["WARC-Type"],
                    "refers_to": int(refers) if refers else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=READ_SCHEMA)

    return index.mapInArrow(
        read,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


READ_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, sha1, record_type, refers_to) to write.

    Of rows with equal payloads of at least ``min_revisit_bytes``, that with the
    largest page_id is the response. Only digests that occur twice or more are
    joined back, from a partial aggregate, so a payload shared by a third of all
    rows costs a row a task. Rows that tie on the largest id are all responses.
    A null page_id counts as smaller than any; a null html is an empty payload.
    """
    text = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", text.alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy(F.col("sha1").alias("of"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("last").isNotNull())
    )
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return (
        rows.join(shared, F.col("sha1") == F.col("of"), "left")
        .withColumn("record_type", F.when(again, RECORD_TYPES[1]).otherwise(RECORD_TYPES[0]))
        .withColumn("refers_to", F.when(again, F.col("last")))
        .select("page_id", "url", "payload", "sha1", "record_type", "refers_to")
    )


def round_trip(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives below ``folder``, normalises them there, and reads all records by the index."""
    written = saved(write_archives(with_revisits(pages, min_revisit_bytes), f"{folder}/whole"), "archives")
    index = saved(normalise(spread(written, "archive"), f"{folder}/members"), "index")
    return read_records(index, folder)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """A few large units of work, dealt out to as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, sha1(html) AS s, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((((instr('0123456789abcdef', substr(s, (5 * i) // 4 + 1, 1)) - 1) * 16
           + instr('0123456789abcdef', substr(s, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT + 1, 1)), '')
        AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""


@query("op8_warc", SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, as read back."""
    found = round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
