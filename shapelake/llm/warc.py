"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2026-01-01T00:00:00Z"


def _store(uri: str):
    """File system and path of a URI, for reading and writing inside tasks.

    Hadoop's names for S3 (``s3a``, ``s3n``) are those of the same store here."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri if colon or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page ``refers_to``."""
    name = lambda k: f"<urn:page:{'null' if k is None else k}>"
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "" if c.isprintable())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


def refer(pages: DataFrame, *, min_bytes: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the page whose equal payload is kept.

    Of payloads of at least ``min_bytes`` that are equal, the page with the
    largest id is kept and has null, as smaller payloads have. Digests, not
    payloads, are grouped. Those of several pages go to all tasks if they are at
    most ``broadcast_rows``, and no payload moves; of more, pages are joined with
    them by a shuffle.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.when(F.octet_length(payload) >= min_bytes, F.sha2(payload, 256)))
    kept = pages.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "kept")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")).alias("refers_to")
    with Scratch(pages.sparkSession) as scratch:
        kept = scratch.keep(kept, "warc-kept")
    if kept.count() <= broadcast_rows:
        return pages.join(F.broadcast(kept), "digest", "left").select("page_id", "url", "html", refers)
    # Small payloads meet nobody; keys of their own spread them over the tasks.
    pages = pages.withColumn("digest", F.coalesce("digest", F.concat(F.lit("small-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("-"), F.xxhash64("url").cast("string"))))
    return pages.join(kept, "digest", "left").select("page_id", "url", "html", refers)


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _store(folder)
        done, held, size = [], [], 0

        def flush():
            # Attempts may get their rows in another order and cut them elsewhere, so none touches another's files.
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:  # members are compressed already
                for member in held:
                    out.write(member)
            done.append((name, size))

        for batch in batches:
            for row in batch.itertuples(index=False):
                member = record(None if pd.isna(row.page_id) else int(row.page_id), row.url, (row.html or "").encode(), None if pd.isna(row.refers_to) else int(row.refers_to))
                held.append(member)
                size += len(member)
                if size >= roll:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if done:
            yield pd.DataFrame(done, columns=["file", "length"])

    return run


def write_warc(pages: DataFrame, folder: str, *, roll: int = 32 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as ``*.warc.gz`` files of
    about ``roll`` bytes in ``folder``, which all executors must share; returns
    (path, length). Each attempt of a task names its files after itself; those of
    the attempts that Spark commits are in the index that is returned, and what
    others left is deleted, so tasks that run twice leave each page once.
    """
    fs, base = _store(folder)
    fs.create_dir(base, recursive=True)
    spark = pages.sparkSession
    written = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInPandas(_writer(folder, roll), "file string, length long")
    written.write.mode("overwrite").parquet(f"{folder}/index")  # runs the write once; names and lengths stay off the driver
    index = spark.read.schema(written.schema).parquet(f"{folder}/index")
    left = archives_in(spark, folder).select(F.substring_index("path", "/", -1).alias("file"))
    left.join(index, "file", "left_anti").mapInPandas(_remover(folder), "file string").write.mode("overwrite").format("noop").save()
    return index.select(F.concat(F.lit(f"{folder}/"), "file").alias("path"), "length")


def _remover(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _store(folder)
        for batch in batches:
            for name in batch["file"]:
                fs.delete_file(f"{base}/{name}")
            yield batch

    return run


class _Bytes:
    """Random reads over one file through a window of ``ahead`` bytes."""

    def __init__(self, file, length: int, ahead: int = 1 << 18):
        self.file, self.length, self.ahead, self.at, self.held = file, length, ahead, 0, b""

    def read(self, start: int, size: int) -> bytes:
        if not (self.at <= start and start + size <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(size, self.ahead))
        return self.held[start - self.at : start - self.at + size]


def member_at(source: _Bytes, start: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``start`` if it is a whole WARC record, else None.

    The head is checked after a first small block, so that magic bytes inside
    compressed data cost little; then the checksum and the length that the
    record's header states.
    """
    unzip, parts, at, step = zlib.decompressobj(31), [], start, 512
    try:
        while not unzip.eof and at < source.length:
            data = source.read(at, min(step, source.length - at))
            parts.append(unzip.decompress(data))
            at += len(data)
            head = b"".join(parts[:4])[: len(VERSION)]
            if not VERSION.startswith(head) or (len(head) < len(VERSION) and unzip.eof):
                return None
            step = 1 << 16
    except zlib.error:
        return None
    if not unzip.eof:
        return None
    content = b"".join(parts)
    headers, _ = parse_headers(content)
    if headers is None or not headers.get("content-length", "").isdigit():
        return None
    body = content.find(b"\r\n\r\n") + 4
    if len(content) != body + int(headers["content-length"]) + 4:
        return None
    return content, at - len(unzip.unused_data)


def parse_headers(content: bytes) -> tuple[dict[str, str] | None, bytes]:
    head, gap, block = content.partition(b"\r\n\r\n")
    if not gap or not head.startswith(VERSION):
        return None, b""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, block


def members(source: _Bytes, start: int, end: int, block: int = 1 << 18) -> Iterator[tuple[int, bytes | None]]:
    """Records that start in [start, end): scan for magic bytes to the first valid
    member, then go from member to member; after damage, scan again. Where a
    member should start (at 0, or where another ended) but none does, the place
    and None."""
    at, due = start, start == 0
    while at < end:
        found = member_at(source, at) if source.read(at, 3) == MAGIC else None
        if found:
            yield at, found[0]
            at, due = found[1], True
            continue
        if due:
            yield at, None
            due = False
        at += 1
        while at < end:
            window = source.read(at, min(block, source.length - at, end - at + 2))
            k = window.find(MAGIC)
            if k >= 0:
                at += k
                break
            at += max(1, len(window) - 2)


RECORDS = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, stated_digest string, content_length long, http_length long, payload binary, error string"


def _reader(with_payload: bool):
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def parsed(path: str, offset: int, content: bytes | None) -> tuple:
        if content is None:
            return (path, offset, *[None] * (len(names) - 3), "no whole WARC record here")
        headers, block = parse_headers(content)
        block = block[: int(headers["content-length"])]
        payload, http = block, None
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            for line in head.split(b"\r\n")[1:]:
                key, _, value = line.partition(b":")
                if key.strip().lower() == b"content-length" and value.strip().isdigit():
                    http = int(value)
        return (path, offset, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-payload-digest"), int(headers["content-length"]), http, payload, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                fs, inside = _store(row.path)
                with fs.open_input_file(inside) as file:
                    out, size = [], 0
                    for offset, content in members(_Bytes(file, row.length), row.start, min(row.stop, row.length)):
                        out.append(parsed(row.path, offset, content))
                        size += len(content or b"")
                        if size > 8 << 20:
                            yield pd.DataFrame(out, columns=names).astype({"http_length": "Int64", "content_length": "Int64"})
                            out, size = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=names).astype({"http_length": "Int64", "content_length": "Int64"})

    return run


def read_warc(archives: DataFrame, *, split_bytes: int = 4 << 20) -> DataFrame:
    """Records of the archives in ``archives`` (path, length), with their payloads.

    Archives are cut into ranges of ``split_bytes``, dealt over tasks. A task
    scans its range for gzip magic, tests each candidate by decoding it as a WARC
    record, and owns the records that start inside, reading past the end of the
    range to finish the last. Where a record should start, behind another or at 0,
    and none can be decoded, one row has nothing but its path, offset and
    ``error``; the scan goes on behind it. Order is by no means kept; ``offset``
    is where a record starts. An empty archive and an empty list give no rows.
    """
    spark = archives.sparkSession
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = archives.select("path", "length", cuts.alias("start")).withColumn("stop", F.col("start") + split_bytes)
    dealt = splits.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "start")
    return dealt.mapInPandas(_reader(True), RECORDS)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the ``*.warc.gz`` files of a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record.

    A response's bytes and digest are those of the payload read. A revisit holds
    no payload; its record states the digest and the length of the payload it
    stands for. Stated digests are SHA-1 in base 32 or hexadecimal, with or
    without ``sha1:``; of any other kind, and where none is stated, the digest is
    null. So are ids that this module did not write. Rows with an error are left out.
    """
    if "error" in records.columns:
        records = records.where("error IS NULL")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))

    def hexadecimal(stated: str | None) -> str | None:
        kind, colon, value = (stated or "").strip().rpartition(":")
        if colon and kind.lower() != "sha1":
            return None
        if len(value) == 40 and not value.strip("0123456789abcdefABCDEF"):
            return value.lower()
        try:
            found = base64.b32decode(value.upper())
        except ValueError:
            return None
        return found.hex() if len(found) == 20 else None

    @F.pandas_udf("string")
    def bare(stated: pd.Series) -> pd.Series:
        return stated.map(hexadecimal)

    revisit = F.col("record_type") == "revisit"
    return records.select(
        as_id(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, bare("stated_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        as_id(F.col("refers_to")).alias("refers_to"),
    )
