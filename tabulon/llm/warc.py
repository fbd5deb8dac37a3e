"""WARC archives: a writer with revisit records and a splittable reader.

Writer. Every task streams its rows into one file of gzip members, one for each record, under a name of
its own attempt. The manifest of files is a table that Spark commits, so the files of lost or repeated
attempts are never read. Of equal payloads the record with the largest id is the response, the others
revisit it; the choice is an aggregate of digests, and payloads move once, by id, so equal payloads meet
in no task.

Reader. Files are cut into byte ranges. A task scans its range for the gzip magic, takes a candidate as a
record if its header decodes and the member begins with a WARC version line, and owns the records that
start inside its range, whatever their length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, ship

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Bytes of a candidate that are decoded to see whether it is a record.
HEAD = 4096
RANGE = 8 << 20
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"


SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to=None) -> bytes:
    """A record as one gzip member: a response with its payload, or a revisit of another record."""
    name = f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, 3, mtime=0)


def _open(path: str):
    """File system and path of a URI; Spark's names of object stores are told in pyarrow's words."""
    scheme, sep, rest = path.partition("://")
    fs, p = pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{sep}{rest}")
    return fs, p


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload binary, refers_to) as archives; the committed manifest (path, bytes, records)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, n, size, out = f"{folder}/data/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    fs, p = _open(path)
                    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(p, compression=None)
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                m = record(None if pd.isna(r.page_id) else int(r.page_id), r.url or "", bytes(r.payload), refers)
                out.write(m)
                n, size = n + 1, size + len(m)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    rows.select("page_id", "url", "payload", "refers_to").mapInPandas(run, "path string, bytes long, records long").write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.schema("path string, bytes long, records long").parquet(f"{folder}/manifest")


def parse(data: bytes) -> dict | None:
    """Headers and block of a record; None if it is not one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        return None
    out = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    out["block"] = rest[: int(out.get("content-length", 0))]
    return out


def scan(read, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the members that start in [start, end); read(offset, n) gives bytes."""
    buf, at, pos = b"", start, start  # buf holds the bytes from at on; candidates start from pos on

    def fill(upto: int) -> None:
        nonlocal buf
        while at + len(buf) < upto and (more := read(at + len(buf), CHUNK)):
            buf += more

    while pos < end:
        fill(pos + CHUNK)
        i = buf.find(MAGIC, pos - at)
        if i < 0:
            if len(buf) - (pos - at) < CHUNK:
                return
            pos = at + len(buf) - len(MAGIC) + 1
            buf, at = buf[pos - at :], pos
            continue
        pos = at + i
        if pos >= end:
            return
        buf, at = buf[i:], pos
        fill(at + HEAD)
        d, out, used, fed = zlib.decompressobj(31), [], 0, 0
        try:
            first = d.decompress(buf[:HEAD], 64)
            if not first.startswith(b"WARC/"):
                raise zlib.error
            d = zlib.decompressobj(31)
            while not d.eof:
                fill(at + fed + CHUNK)
                piece = buf[fed : fed + CHUNK]
                if not piece:
                    raise zlib.error
                out.append(d.decompress(piece))
                fed += len(piece)
            used = fed - len(d.unused_data)
        except zlib.error:
            pos += 1  # not a member: the magic within other data, or a torn file
            continue
        yield pos, b"".join(out)
        pos += used
        buf, at = buf[used:], pos


def read_warc(spark: SparkSession, files: DataFrame, span: int = RANGE, payloads: bool = True) -> DataFrame:
    """Records of files (path, bytes): page_id, payload_bytes, payload_digest, record_type, refers_to, url, path, offset, payload.

    A revisit's payload is null; length and digest are those its headers state. A response whose payload
    doesn't have the stated digest raises an error. Torn members aren't records: ``complete`` compares what was read with
    what was written. Without ``payloads`` they are checked, but not given. There are as many partitions as ranges, ``MOST_TASKS``
    at most: their rows are small, so adaptive execution would put all of them into a few tasks.
    """
    ship(spark)
    count = files.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("bytes") / span), F.lit(1))), F.lit(1))).first()[0]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "offset", "payload"]
        for b in batches:
            for r in b.itertuples(index=False):
                fs, p = _open(r.path)
                rows, size = [], 0
                with fs.open_input_file(p) as f:

                    def read(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    for offset, data in scan(read, r.start, r.end):
                        if (x := parse(data)) is None:
                            continue
                        ids = [None if v in ("", "None") else int(v) for v in (x.get(k, "").strip("<>").rpartition(":")[2] for k in ("warc-record-id", "warc-refers-to"))]
                        want, payload = x["warc-payload-digest"].rpartition(":")[2], None
                        length = int(x["warc-payload-length"])
                        if x["warc-type"] == "response":
                            payload = x["block"].partition(b"\r\n\r\n")[2]
                            length = len(payload)
                            if digest(payload) != want:
                                raise ValueError(f"{r.path} at {offset}: payload digest differs")
                        rows.append((ids[0], length, want, x["warc-type"], ids[1], x.get("warc-target-uri", ""), r.path, offset, payload if payloads else None))
                        size += len(data) if payloads else 256
                        if size > 16 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(span).cast("long")))
    ranges = files.select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("start") + span, "bytes").alias("end"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long, payload binary"
    return ranges.repartition(min(int(count), MOST_TASKS), "path", "start").mapInPandas(run, schema)


def complete(records: DataFrame, files: DataFrame) -> None:
    """Raise if records (path) aren't as many for each of files (path, records) as were written."""
    got = records.groupBy("path").agg(F.count(F.lit(1)).alias("got"))
    short = files.join(got, "path", "left").where("records <> coalesce(got, 0)").select("path", "records", F.coalesce("got", F.lit(0)).alias("got")).limit(5).collect()
    if short:
        raise ValueError("archives don't hold what was written: " + "; ".join(f"{r.path}: {r.got} of {r.records} records" for r in short))


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and read the archives back: read_warc's columns but the payload.

    Raises if a record that was written isn't read.

    The payload is the html in UTF-8; a null one is empty. Of payloads equal and of at least ``least``
    bytes, that with the largest page_id is the response (all of them, if rows repeat that id), others
    revisit it. A null page_id is the smallest. An empty table gives no records.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    seen = scratch.write(rows.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")), "digests")
    last = scratch.write(seen.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("last")), "last")
    revisits = seen.where(F.col("n") >= least).join(last, "sha").where(F.coalesce(F.col("page_id") < F.col("last"), F.col("last").isNotNull()))
    revisits = scratch.write(revisits.select(F.col("page_id").alias("id"), "sha", F.col("last").alias("refers_to")).distinct(), "revisits")
    plan = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.sha1("payload") == F.col("sha")), "left")
    files = write_warc(plan.select("page_id", "url", "payload", "refers_to"), scratch.path("archives"))
    records = scratch.write(read_warc(pages.sparkSession, files, payloads=False).drop("payload"), "records")
    complete(records, files)
    return records
