"""WARC: gzip-per-record archives and a splittable reader.

Writing: one .warc.gz a task, one gzip member a record. Of pages with equal payloads of at least
``min_bytes`` the one with the largest page_id is a response and the others revisit it.
Reading: a task owns a byte range of a file. It scans the range for the gzip magic, validates a
candidate by decoding the start of its member to a WARC header, then follows the members one after
another; it owns the records that start inside its range and reads the last one past the range's end.

Null html: an empty payload. Null page_id: below all others, written and read back as null. Null
url: the target is ``urn:x-unknown``. Repeated rows (page_id and payload): all of the same type, so
all are responses where their page_id is the largest. Empty table: no file and no row. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlens.llm.common import scratch, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
MAX_TASKS = 20_000
CHUNK = 1 << 16
#: Bytes of a member that a validation decodes at most, before the whole member is decoded.
PROBE = 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
ROWS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """Header-safe form of a url: white space, controls and non-ASCII are percent-encoded."""
    if url is None:
        return "urn:x-unknown"
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, revisit=False) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}:{digest}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}:{digest}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that are revisits; payloads are not shuffled."""
    ids = pages.select("page_id", F.coalesce("html", F.lit("")).alias("h")).where(F.octet_length("h") >= min_bytes)
    ids = ids.select("page_id", F.sha1(F.encode("h", "utf-8")).alias("digest"))
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return ids.distinct().join(last, "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 4) -> DataFrame:
    """Write the archives; returns the manifest (file, bytes), one row a file that counts."""

    def write(batches):
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context, out, size = TaskContext.get(), None, 0
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"

        def put(data: bytes):
            nonlocal size
            member = gzip.compress(data, level, mtime=0)
            out.write(member)
            size += len(member)

        for pdf in batches:
            for page_id, url, html, revisit, refers_to in pdf.itertuples(index=False):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:%s>\r\nWARC-Date: %s\r\n"
                        b"Content-Length: 0\r\n\r\n\r\n\r\n" % (name.encode(), DATE.encode()))  # fmt: skip
                put(record(page_id, url, (html or "").encode(), refers_to, revisit))
        if out:
            out.close()
            yield pd.DataFrame({"file": [f"{folder}/{name}"], "bytes": [size]})

    made = decisions(pages, min_bytes).withColumn("revisit", F.lit(True))
    own = pages.select("page_id", "url", "html").withColumn(
        "digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    )
    pairs = own.alias("p").join(
        made.alias("m"),
        F.col("p.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("p.digest") == F.col("m.digest")),
        "left",
    )
    rows = pairs.select(
        F.col("p.page_id").cast("string").alias("page_id"), "url", "html",
        F.coalesce("revisit", F.lit(False)).alias("revisit"), F.col("refers_to").cast("string").alias("refers_to"),
    )
    return written(rows.mapInPandas(write, "file string, bytes long"), "warc-manifest")


def _member(f, at: int, size: int, check: bytes = b"WARC/1.") -> tuple[bytes, int] | None:
    """The decoded member that starts at ``at`` and where it ends; None if it isn't a record."""
    f.seek(at)
    d, out, fed = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            data = f.read(PROBE if fed == at else CHUNK)
            if not data:
                return None  # cut short
            fed += len(data)
            out.append(d.decompress(data))
            if check and sum(map(len, out)) >= len(check):
                if not b"".join(out).startswith(check):
                    return None
                check = b""
    except zlib.error:
        return None
    return (b"".join(out), fed - len(d.unused_data)) if not check else None


def members(f, size: int, start: int, end: int):
    """Records that start in [start, end)."""
    at, known = start, start == 0  # known: at is a member's start
    while at < end:
        if known and (got := _member(f, at, size)):
            yield got[0]
            at = got[1]
            continue
        known, found = False, -1
        while at < end and found < 0:
            f.seek(at)
            window = f.read(min(CHUNK, end - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                at += min(CHUNK, end - at)
        if found < 0 or at + found >= end:
            return
        at += found
        if _member(f, at, size) is None:
            at += 1
        else:
            known = True


def parse(data: bytes) -> dict | None:
    """One row of a response or revisit record; None for other types."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (base32_sha1(payload) != told or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")

    def page(uri):
        got = uri.removeprefix("<urn:x-page:").split(":")[0]
        return None if got == "None" else got

    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length,
        "payload_digest": told, "record_type": kind,
        "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of the records of ``files`` (file, bytes), one task a byte range or a few."""
    ranges = files.where("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    )

    def read(batches):
        import pyarrow.fs

        for pdf in batches:
            for row in pdf.itertuples():
                fs, path = pyarrow.fs.FileSystem.from_uri(row.file)
                with fs.open_input_file(path) as f:
                    rows = []
                    for data in members(f, row.bytes, row.start, min(row.start + split_bytes, row.bytes)):
                        if got := parse(data):
                            rows.append(got)
                    if rows:
                        yield pd.DataFrame(rows)

    # a number of its own: few bytes name much work, so sizes must not merge the ranges
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    got = ranges.repartition(min(int(n), MAX_TASKS), "file", "start").mapInPandas(read, ROWS)
    return got.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = read_warc(write_warc(pages, scratch(spark, "warc")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
