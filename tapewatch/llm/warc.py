"""Pages as WARC archives: response and revisit records, read back in whole and by the capture index.

Records of one payload: the one with the smallest page_id (and URL) is a response, the others are
revisits that refer to it; payloads below ``least_bytes`` are all responses.  Records are gzip
members of their own, so any of them can be read alone.

Tasks write files of their own, under names no other attempt uses, and report what they hold;
only what ends up in the manifest counts, so a task may be lost and run again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.llm.capture_index import build_index, look_up, url_key
from tapewatch.llm.columns import pick
from tapewatch.llm.storage import Ranges, Writer, make_folder
from tapewatch.session import ship_package

DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
FILE_BYTES = 1 << 30
# Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "key string, file string, offset long, length long, page_id long"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_key string, file string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return str(uuid.UUID(bytes=hashlib.sha1(f"{page_id}\n{url}\n{digest}".encode()).digest()[:16], version=5))


def capture_key(url: str | None, date: str, record_id: str) -> str:
    """The index's key of a record: reversed URL, 14-digit date, id."""
    return f"{url_key(url)} {''.join(c for c in date if c.isdigit())} {record_id}"


def _field(value: str) -> str:
    """Header values stay on their line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def _build(page_id: int | None, url: str | None, payload: bytes, digest: str, first: dict | None, date: str) -> tuple[str, bytes]:
    """Record id and record; ``first`` (page_id, url) makes it a revisit of that page."""
    own = _record_id(page_id, url, digest)
    block = HTTP % len(payload) + (b"" if first else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: <urn:uuid:{own}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first:
        there = _record_id(first["page_id"], first["url"], digest)
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:uuid:{there}>", f"WARC-Refers-To-Date: {date}"]
        if first["url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_field(first['url'])}")
    head.append(f"Content-Length: {len(block)}")
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE,
                   page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``pages`` to WARC files, their manifest and their index below ``path``.

    A null html is an empty payload, a null URL leaves its header out, a null page_id as well;
    null ids come after all others when the response of a payload is chosen.  Rows equal to the
    chosen one in page_id and URL are responses, too.
    """
    spark = pages.sparkSession
    ship_package(spark)
    make_folder(f"{path}/archive")
    rows = pick(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    repeated = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("sha").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("sha", "first"))
    told = rows.join(repeated, "sha", "left").select(
        "page_id", "url", "payload",
        F.when(place != F.col("first"), F.struct("first.page_id", "first.url")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or out.size > FILE_BYTES:
                    if out:
                        out.close()
                    out = Writer(f"{path}/archive/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz")
                own, record = _build(row["page_id"], row["url"], row["payload"], base32_sha1(row["payload"]), row["first"], date)
                offset, length = out.write(_gzip(record))
                rows.append((capture_key(row["url"] and _field(row["url"]), date, own), out.path, offset, length, row["page_id"]))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "file", "offset", "length", "page_id"])
        if out:
            out.close()

    told.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    build_index(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), f"{path}/index")


def _parse(record: bytes) -> dict:
    """A row of RECORD without its place; the digest of a response is taken from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    row = {"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "record_type": fields["WARC-Type"],
           "payload_bytes": None, "payload_digest": told, "refers_to_key": None}
    if fields["WARC-Type"] == "revisit":
        there = fields["WARC-Refers-To"].removeprefix("<urn:uuid:").removesuffix(">")
        return row | {"refers_to_key": capture_key(fields.get("WARC-Refers-To-Target-URI"), fields["WARC-Refers-To-Date"], there)}
    payload = block.partition(b"\r\n\r\n")[2]
    if base32_sha1(payload) != told:
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload does not have the digest {told}")
    return row | {"payload_bytes": len(payload)}


def _records(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of one member after the other."""
    offset, data = 0, stream.read(chunk)
    while data:
        member, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(member.decompress(data))
            if member.eof:
                used += len(data) - len(member.unused_data)
                data = member.unused_data
                break
            used += len(data)
            data = stream.read(chunk)
            if not data:
                raise EOFError("an archive ends within a record")
        yield offset, b"".join(parts)
        offset += used
        data = data or stream.read(chunk)


_RECORD_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
_RECORD_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kind) for n, kind in zip(_RECORD_NAMES, _RECORD_KINDS, strict=True)], _RECORD_NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives, one after the other, as RECORD; one task reads whole files."""
    ship_package(spark)
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file").distinct()
    # a list of names is few bytes, which Spark would put into one task: each archive gets its own
    files = files.repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with Ranges().stream(file) as stream:
                    for offset, record in _records(stream):
                        rows.append(_parse(record) | {"file": file, "offset": offset})
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return files.mapInArrow(run, RECORD)


def fetch(captures: DataFrame) -> DataFrame:
    """key and the parsed record of each capture (key, file, offset, length), by range reads."""
    ship_package(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            rows = [_parse(zlib.decompress(ranges.read(r["file"], r["offset"], r["length"]), 31))
                    | {"file": r["file"], "offset": r["offset"]} for r in batch.to_pylist()]
            yield _batch(rows).append_column("key", batch.column("key"))
        ranges.close()

    return captures.select("key", "file", "offset", "length").mapInArrow(run, f"{RECORD}, key string")


def resolved(records: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    What a revisit refers to is looked up in the index, once however many refer to it, and
    read from its archive.  Every revisit must find it.
    """
    revisits = records.where("record_type = 'revisit'")
    targets = look_up(revisits.select(F.col("refers_to_key").alias("key")), f"{path}/index",
                      "file string, offset long, length long, page_id long")
    # equal records have equal keys; any of them will do
    there = fetch(targets).groupBy("key").agg(
        F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"), F.max("page_id").alias("refers_to"))
    joined = revisits.join(there, F.col("refers_to_key") == F.col("key"), "left").select(
        "page_id",
        F.when(F.col("digest") == F.col("payload_digest"), F.col("bytes")).otherwise(
            F.raise_error(F.lit("a revisit whose response is not in the index")).cast("long")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")
    return records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(joined)
