"""WARC archives: writing, and a normaliser for archives that are one gzip stream.

``write_archives`` gives each partition one archive, compressed as a whole, as crawlers without record-wise compression
leave them; no record of such a file can be read without inflating all before it. ``normalise`` inflates each of them once,
as a stream, writes every record again as a gzip member of its own and returns a sidecar index (archive, offset, length)
for each record. ``read_records`` reads members by that index, in any order.

Payloads that occur more than once are written once, as a response; the others are revisit records that refer to it.
Files have names that no other attempt uses; which of them count is told by a Parquet table that Spark commits, so lost
or repeated tasks leave no trace in results.

Defined cases: a null payload is empty; an empty payload is a payload like any other; of rows with equal payload and equal
smallest page_id all are responses; a null page_id comes after all others and is written as ``null``; a null URL gives
a record without target; an empty table gives no archives and an empty index; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, local_path, lookup, partitions, removed, staged, table

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit holds headers only, among them the size of the payload that it stands for."""
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields[-1:-1] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{'null' if refers_to is None else refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"".join((VERSION, b"\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"))


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines if x)}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in chunks of bounded size."""
    engine, data, inside = zlib.decompressobj(31), stream.read(CHUNK), False
    while data:
        inside = True
        made = engine.decompress(data, CHUNK)
        if made:
            yield made
        data = engine.unconsumed_tail
        if engine.eof:
            data, engine, inside = engine.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
        elif not data and len(made) == CHUNK:  # output may wait inside the engine
            while made := engine.decompress(b"", CHUNK):
                yield made
            if engine.eof:
                data, engine, inside = engine.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
        data = data or stream.read(CHUNK)
    if inside:
        raise ValueError("an archive is cut off")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) one after the other; holds one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            fields = parse_head(bytes(held[:end]))
            size = end + 4 + int(fields["content-length"]) + 4
            if len(held) < size:
                break
            yield fields, bytes(held[:size])
            del held[:size]
    if held.strip(b"\r\n"):
        raise ValueError("a record is cut off")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): refers_to is the smallest page_id with the same payload."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    keyed = plain.select("*", F.sha1("html").alias("sha1"))
    # Counted before any row moves; rows of very common payloads then stay where they are, so no task gets all copies of one page.
    again = keyed.groupBy("sha1").agg(F.count("*").alias("count"), F.min("page_id").alias("first")).where("count > 1")
    again = staged(again.withColumn("again", F.lit(True)), "warc-payloads")
    joined = lookup(keyed, again.drop("count"), "sha1", again, "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


ARCHIVES = "archive string, n_records long, bytes long"


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write every row as a record, a gzip stream for each partition, and return the committed list of archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_path(folder)
        files.create_dir(base, recursive=True)
        name, out, n, size = f"crawl-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", None, 0, 0
        engine = zlib.compressobj(level, wbits=31)
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or files.open_output_stream(f"{base}/{name}", compression=None, buffer_size=CHUNK)
                made = engine.compress(record(page_id, url, html, refers_to, revisit))
                out.write(made)
                n, size = n + 1, size + len(made)
        if out is not None:
            made = engine.flush()
            out.write(made)
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size + len(made)], pa.int64())], ["archive", "n_records", "bytes"])

    spark = pages.sparkSession
    with_revisits(pages).mapInArrow(write, ARCHIVES).write.parquet(f"{folder}/archives")
    return spark.read.schema(ARCHIVES).parquet(f"{folder}/archives")


INDEX = "archive string, offset long, length long, record_id string, record_type string"


def normalise(spark: SparkSession, source: str, archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite archives of folder source with one member for each record; returns the sidecar index of the new ones."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, base), (new_files, new_base) = local_path(source), local_path(folder)
        new_files.create_dir(new_base, recursive=True)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name, at, rows = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz", 0, []
                with files.open_input_stream(f"{base}/{archive}", compression=None) as old, new_files.open_output_stream(f"{new_base}/{name}", compression=None, buffer_size=CHUNK) as new:
                    for fields, whole in split_records(inflated(old)):
                        engine = zlib.compressobj(level, wbits=31)
                        member = engine.compress(whole) + engine.flush()
                        new.write(member)
                        rows.append((name, at, len(member), fields["warc-record-id"], fields["warc-type"]))
                        at += len(member)
                        if len(rows) == 10_000:
                            yield pa.record_batch([pa.array(c) for c in zip(*rows)], NAMES)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], NAMES)

    dealt = archives.select("archive").repartitionByRange(2 * partitions(spark), "archive")
    dealt.mapInArrow(rewrite, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


NAMES = [x.split()[0] for x in INDEX.split(", ")]
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def page_of(urn: str) -> int | None:
    """The page_id in a record id."""
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """What each indexed record says; the digest of a response is checked against its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = local_path(folder)
        name, stream = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if stream is not None:
                        stream.close()
                    name, stream = archive, files.open_input_file(f"{base}/{archive}")
                ((fields, whole),) = split_records(iter([zlib.decompress(stream.read_at(length, offset), 31)]))
                told = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit:
                    payload = whole[len(whole) - 4 - int(fields["content-length"]) : -4]
                    if digest(payload) != told or len(payload) != int(fields["x-payload-length"]):
                        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                rows.append((page_of(fields["warc-record-id"]), int(fields["x-payload-length"]), told, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in READ.split(", ")])

    return index.select("archive", "offset", "length").mapInArrow(read, READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as whole-file streams, normalise them and read every record back."""
    raw, clean = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc-normalised")
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), raw)
    index = normalise(spark, raw, archives, clean)
    removed(raw)  # the index is committed, so the streams are not needed again
    return read_records(index, clean)


_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, CAST(10 * (i // 8) + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31), 1)), 'string_agg', '')"
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
