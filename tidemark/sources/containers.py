"""Packed containers of payloads, images of raw pixels, and their rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import to_little_endian

# Head of an interleaved container, and places in an image's head.
MAGIC, VERSION, HEAD_FORM, HEAD_BYTES = 0x42504148, 2, "<IHHIQ", 20
WIDTH_AT, HEIGHT_AT, STRIDE_AT, FORMAT_AT, PIXELS_AT, RGBA = 16, 20, 24, 28, 36, 1


def entries(data: bytes, grouped_magic: bytes = b"") -> list[tuple[str, bytes]]:
    """Names and payloads of a container; ValueError if its sizes do not add up. Interleaved: head, then name and payload by
    turns. Grouped (where grouped_magic starts it): all sizes and names, then all payloads."""
    if grouped_magic and data.startswith(grouped_magic):
        return _grouped(data, len(grouped_magic))
    if len(data) < HEAD_BYTES:
        raise ValueError("container is too short")
    magic, version, head, count, size = struct.unpack_from(HEAD_FORM, data)
    if magic != MAGIC or version != VERSION or head < HEAD_BYTES:
        raise ValueError("not a container of a known version")
    at, out, total = head, [], 0
    for _ in range(count):
        name, at, n = _name(data, at)
        out.append((name, _take(data, at, n)))
        at, total = at + n, total + n
    if at != len(data) or total != size:
        raise ValueError("container has bytes too many or too few")
    return out


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("container is cut short")
    return data[at : at + n]


def _name(data: bytes, at: int) -> tuple[str, int, int]:
    n, size = struct.unpack("<IQ", _take(data, at, 12))
    return _take(data, at + 12, n).decode(), at + 12 + n, size


def _grouped(data: bytes, at: int) -> list[tuple[str, bytes]]:
    (count,) = struct.unpack("<I", _take(data, at, 4))
    at, heads, out = at + 4, [], []
    for _ in range(count):
        name, at, n = _name(data, at)
        heads.append((name, n))
    for name, n in heads:
        out.append((name, _take(data, at, n)))
        at += n
    if at != len(data):
        raise ValueError("container has bytes too many")
    return out


def pack(items: list[tuple[str, bytes]]) -> bytes:
    """An interleaved container."""
    body = b"".join(struct.pack("<IQ", len(n.encode()), len(d)) + n.encode() + d for n, d in items)
    return struct.pack(HEAD_FORM, MAGIC, VERSION, HEAD_BYTES, len(items), sum(len(d) for _, d in items)) + body


def explode_containers(rows: DataFrame, content: str, keys: list[str], grouped_magic: bytes = b"") -> DataFrame:
    """keys, ord, name, data: a row for each payload of each container; error instead of them where one cannot be parsed."""
    fields = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    found = [(k, n, d, None) for k, (n, d) in enumerate(entries(r[content], grouped_magic))]
                except (ValueError, UnicodeDecodeError) as e:
                    found = [(None, None, None, str(e))]
                columns = {k: [r[k]] * len(found) for k in keys} | dict(zip(("ord", "name", "data", "error"), map(list, zip(*found)))) if found else {k: [] for k in [*keys, "ord", "name", "data", "error"]}
                types = {k: b.schema.field(k).type for k in keys} | {"ord": pa.int64(), "name": pa.string(), "data": pa.binary(), "error": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))

    return rows.select(*keys, content).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", ord long, name string, data binary, error string")


def containers_of(rows: DataFrame, key: str, grouped_magic: bytes = b"") -> DataFrame:
    """key, content: for each key the container of its rows' name and data in order of ord: interleaved, or grouped behind grouped_magic.
    What did not read (a null data) has no bytes but keeps its name. A key's payloads are one file."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "name", "data"))).alias("items"))
    name = lambda x: F.encode(x["name"], "UTF-8")
    data = lambda x: F.coalesce(x["data"], F.lit(b"").cast("binary"))
    head = lambda x: F.concat(F.hex(to_little_endian(F.length(name(x)), 4)), F.hex(to_little_endian(F.length(data(x)), 8)), F.hex(name(x)))
    joined = lambda part: F.array_join(F.transform("items", part), "")
    count = F.hex(to_little_endian(F.size("items"), 4))
    if grouped_magic:
        content = F.concat(F.lit(grouped_magic.hex()), count, joined(head), joined(lambda x: F.hex(data(x))))
    else:
        size = F.aggregate(F.transform("items", lambda x: F.length(data(x)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        fixed = struct.pack("<IHH", MAGIC, VERSION, HEAD_BYTES).hex()
        content = F.concat(F.lit(fixed), count, F.hex(to_little_endian(size, 8)), joined(lambda x: F.concat(head(x), F.hex(data(x)))))
    return listed.select(key, F.unhex(content).alias("content"))


def pixels(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and rows of RGBA pixels without padding, of an image of raw pixels."""
    if len(data) < PIXELS_AT:
        raise ValueError("image is too short")
    width, height, stride, form = (struct.unpack_from("<I", data, at)[0] for at in (WIDTH_AT, HEIGHT_AT, STRIDE_AT, FORMAT_AT))
    if form != RGBA or stride < 4 * width or len(data) < PIXELS_AT + stride * height:
        raise ValueError("image has another format or is cut short")
    return width, height, b"".join(data[PIXELS_AT + stride * y : PIXELS_AT + stride * y + 4 * width] for y in range(height))


def png(width: int, height: int, rgba: bytes, level: int = 6) -> bytes:
    """A PNG file of RGBA pixels."""
    lines = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")
