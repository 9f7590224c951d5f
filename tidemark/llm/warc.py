"""WARC archives: one gzip member for each record, identical payloads stored once, and a reader that splits files.

The reader needs no index. A task owns a range of bytes and the records that start in it. It looks for gzip's magic
bytes, which also occur by chance inside compressed data, so a candidate is a record only if it inflates to a
head that starts as a WARC record does; from a record on, the next one starts where its member ends. The last record of a
range is read to its end beyond the range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, materialise, open_store, parallelism, scratch_dir, text_or_empty

MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's window bits for one gzip member
VERSION = b"WARC/1.1\r\n"
LEAST_REVISIT = 1000
#: Bytes that a read task owns, and those that it reads at a time.
SPLIT, CHUNK = 8 << 20, 1 << 20
#: The archive's time: no clock, so a rerun writes the same bytes.
DATE = "2000-01-01T00:00:00Z"


def sha1_name(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def from_urn(name: str | None) -> int | None:
    value = (name or "").strip("<>").rpartition(":")[2]
    return int(value) if value not in ("", "none") else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or (payload None) a revisit of refers_to without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or "").split())), ("WARC-Payload-Digest", sha1_name(digest)), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if payload is None:
        head[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to))]
    data = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return pack.compress(data) + pack.flush()


def parse(data: bytes) -> dict:
    """A whole inflated record: its WARC fields (lower-case names) and its block."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.decode().split(": ", 1) if ": " in line.decode() else (line.decode().rstrip(":"), "") for line in head.split(b"\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    n = int(fields["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
    return {"fields": fields, "block": rest[:n]}


def write_archives(pages: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the manifest of files (file, bytes).

    Of equal payloads of at least LEAST_REVISIT bytes the one with the largest page_id is the response, rows that share that
    page_id too; the others revisit it. A null html is an empty payload, a null page_id never the largest: where
    none has one, all are responses. Other columns are not read. A lost task's file is in no manifest.
    """
    spark = pages.sparkSession
    payload = F.encode(text_or_empty("html"), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("size"))
    # Partial maxima first: a payload that a third of all rows share is a row of each task here.
    kept = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "kept")
    # Who revisits whom is decided without payloads; then each page gets its own answer.
    large = rows.where(F.col("size") >= LEAST_REVISIT).select("page_id", "digest")
    revisits = large.join(kept, large["digest"] == kept["of"]).where(~F.col("page_id").eqNullSafe(F.col("kept"))).select(F.col("page_id").alias("asks"), "of", F.col("kept").alias("refers_to")).distinct()
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["asks"]) & (rows["digest"] == revisits["of"]), "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
            for batch in batches:
                for page_id, url, payload, n, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    f.write(member := record(page_id, url, payload, n, digest, refers_to))
                    size += len(member)
        yield pa.RecordBatch.from_pylist([{"file": name, "bytes": size}] if size else [], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    return materialise(in_arrow(rows, write, "file string, bytes long"), "warc-manifest")


def inflate(data: bytes | memoryview, more) -> tuple[bytes, int]:
    """The member at the start of data and its length; more() gives the bytes after data, b"" at the end of the file."""
    z = zlib.decompressobj(GZIP)
    out, used = [], 0
    while True:
        out.append(z.decompress(data))
        used += len(data) - len(z.unused_data)
        if z.eof:
            return b"".join(out), used
        data = more()
        if not data:
            raise zlib.error("the member has no end")


def starts_record(data: bytes | memoryview) -> bool:
    """Whether data starts with a gzip member whose first bytes are those of a WARC record."""
    try:
        return zlib.decompressobj(GZIP).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(f, begin: int, end: int, size: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, inflated record) of the records of an open archive that start in [begin, end)."""
    at, known = begin, begin == 0
    buffer, base = b"", begin

    def fill(upto: int) -> None:
        nonlocal buffer
        while base + len(buffer) < min(upto, size):
            f.seek(base + len(buffer))
            got = f.read(chunk)
            if not got:
                break
            buffer += got

    while at < min(end, size):
        if at - base > 4 * chunk:
            buffer, base = buffer[at - base :], at
        fill(at + 512)
        if not known:
            k = buffer.find(MAGIC, at - base)
            while k < 0 and base + len(buffer) < min(end + len(MAGIC), size):
                at = base + max(0, len(buffer) - len(MAGIC) + 1)
                fill(base + len(buffer) + 1)
                k = buffer.find(MAGIC, at - base)
            if k < 0 or base + k >= end:
                return
            at = base + k
            fill(at + 512)
            if not starts_record(memoryview(buffer)[k : k + 512]):
                at += 1
                continue
        place = len(buffer)

        def more() -> bytes:
            nonlocal place
            if place >= len(buffer):
                fill(base + len(buffer) + 1)
            got, place = buffer[place:], len(buffer)
            return got

        data, used = inflate(memoryview(buffer)[at - base :], more)
        yield at, data
        at, known = at + used, True


def read_archives(files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of archives (file, bytes) in folder: file, place, record_type, page_id, url, refers_to, payload_digest
    (SHA-1 in hex), payload_bytes (of the full payload) and payload (null for a revisit). ValueError if a digest does not hold."""
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("begin")).repartition(parallelism(files.sparkSession), "file", "begin")
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                out, held = [], 0
                with fs.open_input_file(f"{root}/{r['file']}") as f:
                    for place, data in records_in(f, r["begin"], min(r["begin"] + split, r["bytes"]), r["bytes"]):
                        x = parse(data)
                        fields, (http, _, payload) = x["fields"], x["block"].partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        size = int(http.lower().partition(b"content-length: ")[2].split(b"\r\n")[0])
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} in {r['file']} is damaged")
                        out.append({"file": r["file"], "place": place, "record_type": kind, "page_id": from_urn(fields["warc-record-id"]), "url": fields["warc-target-uri"], "refers_to": from_urn(fields.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None})
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return in_arrow(ranges, read, "file string, place long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as archives, then read back in splits."""
    folder = scratch_dir(spark, "warc")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
