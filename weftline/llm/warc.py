"""WARC archives: write, read, and revisit resolution.

Records with equal payloads keep one body. Headers (id, URL, digest, length) alone decide: digests are counted with partial
aggregation, those that occur more than once are written as a table, and only rows whose digest may be in it (a bounded
bitmap tells) meet it in a join; payloads of the others are never shuffled. The archives get fresh headers.

An archive is a ``.warc.gz`` file of one gzip member a record, the first of which is a warcinfo record, and is closed when it
has ``part_bytes``. A task writes files under names of its own and returns them; what the table ``_manifest`` then lists is
the result, and files of attempts that were lost are deleted. Files are written and read as streams, so memory follows the
longest record and not the file. The folder must be in a store that ``pyarrow.fs`` opens (local or shared file systems,
HDFS, S3, GCS).

Defined results: a null payload is empty. A null id is written without its header and read back as null; a null URL gives no
WARC-Target-URI. Line breaks in a URL are percent-encoded. Of equal payloads the record with the largest id (null
lowest, then the larger URL) is the response; rows that repeat id, URL and payload are one capture, so each of them has
its record type and record id. An empty table gives no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import apart, keep, new_path

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
READ_SCHEMA = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload string, intact boolean"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a lambda's outer expressions are computed at each call

    def letters(bits: Column) -> Column:
        return F.concat(*(F.substring(F.lit(ALPHABET), (F.shiftright(bits, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)))

    def coded(hexed: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("long"))
        return F.array_join(F.transform(parts, letters), "")

    return once(F.sha1(data), coded)


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = 0) -> DataFrame:
    """id, url, payload, digest, bytes, record_type and refers_to (both as strings where ids) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    order = F.struct("id", "url")
    twice = rows.filter(F.col("bytes") >= at_least).groupBy("digest", "bytes").agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    # a table of its own, so that the join with a hot digest can be split
    one = keep(pages.sparkSession, twice.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first", F.xxhash64("digest", "bytes").alias("key")), "repeated")
    single, likely = apart(rows.withColumn("key", F.xxhash64("digest", "bytes")), one, "key")
    joined = likely.join(one.drop("key"), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisits = F.col("first").isNotNull() & ~(F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.url").eqNullSafe(F.col("url")))
    cols = ["id", "url", "payload", "digest", "bytes"]
    out = joined.select(*cols, F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first.id")).alias("refers_to"), F.when(revisits, F.col("first.url")).alias("refers_url"))
    none = lambda c: F.lit(None).cast(out.schema[c].dataType).alias(c)
    return out.unionByName(single.select(*cols, F.lit("response").alias("record_type"), none("refers_to"), none("refers_url")))


def _uuid(*parts: Column) -> Column:
    """A record id that is the same for the same capture."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts]
    return F.regexp_replace(F.md5(F.concat_ws(" ", *marked)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def record_text(date: str) -> Column:
    """The text of one record without its final CRLF CRLF, from the columns of ``resolve``."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HEAD), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", _uuid(F.col("id"), F.col("url"), F.col("digest"))), _header("X-Page-ID", F.col("id").cast("string")),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", clean(F.col("url"))), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _header("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("refers_url"), F.col("digest"))), _header("WARC-Refers-To-Date", F.lit(date)), _header("X-Refers-To-Page-ID", F.col("refers_to").cast("string")), _header("WARC-Refers-To-Target-URI", clean(F.col("refers_url"))))).otherwise(""),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    local = re.sub("^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def _member(data: bytes) -> bytes:
    """A gzip member."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _info(name: str, date: str) -> bytes:
    body = "software: weftline\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return (CRLF.join(head) + CRLF + CRLF + body + CRLF + CRLF).encode()


def _write(batches: Iterator[pa.RecordBatch], path: str, date: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Write the texts of a task's records; gives name, records and bytes of each file once it is closed."""
    system, folder = _place(path)
    out, name, records, size = None, "", 0, 0

    def close() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["name", "records", "bytes"])

    for batch in batches:
        column = batch.column("value")
        for i in range(len(column)):
            if out is None:
                name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                system.create_dir(folder)
                # the members are compressed already
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
                size += out.write(_member(_info(name, date))) or 0
            member = _member(memoryview(column[i].as_buffer()).tobytes() + b"\r\n\r\n")
            out.write(member)
            records, size = records + 1, size + len(member)
            if size >= part_bytes:
                yield close()
                out = None
    if out is not None:
        yield close()


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            system, path = _place(uri)
            system.delete_file(path)
        yield batch


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path).select("path")


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", part_bytes: int = 128 << 20) -> DataFrame:
    """Write resolved records as archives of about ``part_bytes`` at most; gives the manifest: name, records and bytes."""
    spark = records.sparkSession
    texts = records.select(record_text(date).alias("value"))
    texts.mapInArrow(lambda it: _write(it, path, date, part_bytes), "name string, records long, bytes long").write.parquet(f"{path}/_manifest")
    manifest = spark.read.parquet(f"{path}/_manifest")
    left = _archives(spark, path).withColumn("name", F.substring_index("path", "/", -1)).join(manifest, "name", "left_anti")
    left.select("path").mapInArrow(_delete, "path string").count()
    return manifest


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Cut a decompressed stream into (headers, block)."""
    buf, at = bytearray(), 0
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        nonlocal at
        while len(buf) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            if at:
                del buf[:at]
                at = 0
            buf.extend(more)
        return True

    while True:
        while fill(2) and buf[at : at + 2] == b"\r\n":
            at += 2
        if not fill(1):
            return
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(buf) - at + 1):
                raise ValueError("archive ends inside a record's headers")
        head = buf[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(headers["content-length"])
        skip = end + 4 - at
        if not fill(skip + size):
            raise ValueError("archive ends inside a record's block")
        block = bytes(buf[at + skip : at + skip + size])
        at += skip + size
        yield headers, block


def _inflate(chunks: Iterator[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """Decompress gzip members one after another, or pass plain bytes through, in steps."""
    piece = next(chunks, b"")
    if piece[:2] != b"\x1f\x8b":
        yield piece
        yield from chunks
        return
    d = zlib.decompressobj(31)
    while piece:
        out = d.decompress(piece, step)
        piece = d.unconsumed_tail
        if d.eof:
            piece, d = d.unused_data.lstrip(b"\x00"), zlib.decompressobj(31)
        if out:
            yield out
        if not piece:
            piece = next(chunks, b"")


def _stream(uri: str, step: int = 1 << 20) -> Iterator[bytes]:
    system, path = _place(uri)
    with system.open_input_stream(path, compression=None) as f:
        while piece := f.read(step):
            yield piece


def _named(headers: dict[str, str], own: str, other: str) -> str | None:
    """The page id of archives written here, else the record id of those from elsewhere."""
    record = headers.get(other, "")
    return headers.get(own) or (None if record.startswith("<urn:uuid:") else record.strip("<>") or None)


def _parse(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for uri in batch.column("path").to_pylist():
            rows, held = [], 0
            for h, block in _records(_inflate(_stream(uri))):
                if h.get("warc-type") not in ("response", "revisit"):
                    continue
                payload = block.partition(b"\r\n\r\n")[2]
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                revisit = h.get("warc-type") == "revisit"
                intact = revisit or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                rows.append((_named(h, "x-page-id", "warc-record-id"), h.get("warc-target-uri"), h.get("warc-type"), None if revisit else len(payload), digest, _named(h, "x-refers-to-page-id", "warc-refers-to"), payload.decode("utf-8", "replace") if with_payload else None, intact))
                held += len(payload) * with_payload + 300
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a response or revisit. A revisit's length is null here; ``follow_revisits`` finds it."""
    return _archives(spark, path).mapInArrow(lambda it: _parse(it, with_payload), READ_SCHEMA)


def follow_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the length of the response that has its digest; headers alone are shuffled."""
    originals = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("found"))
    originals = keep(records.sparkSession, originals, "originals")
    revisits = records.filter("record_type = 'revisit'").join(originals, "payload_digest", "left")
    revisits = revisits.withColumn("payload_bytes", F.col("found")).drop("found").select(*records.columns)
    return records.filter("record_type <> 'revisit'").unionByName(revisits)


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None, at_least: int = 0, **cols: str) -> DataFrame:
    """Write deduplicated archives of ``pages``, read them back and follow the revisits."""
    path = path or new_path(spark, "warc")
    write_archives(resolve(pages, at_least=at_least, **cols), path)
    return follow_revisits(keep(spark, read_archives(spark, path), "records"))
