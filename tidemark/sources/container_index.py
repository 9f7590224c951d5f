"""Containers of any size taken apart by their heads: one pass finds where each entry lies, tasks read the ranges.

The first pass reads heads alone, in blocks, and skips payloads; the second deals the entries out, so a container larger than a task's memory is
taken apart by many tasks, each holding one payload at a time. What is damaged is told by entry: those before it are whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containers import HEAD_BYTES, HEAD_FORM, MAGIC, VERSION
from .files import open_store

BLOCK, HELD = 1 << 16, 4 << 20
INDEX = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("error", pa.string())])


class Blocks:
    """Small reads of an open file, by whole blocks."""

    def __init__(self, f: pa.NativeFile, size: int):
        self.f, self.size, self.begin, self.held = f, size, 0, b""

    def take(self, at: int, n: int) -> bytes:
        """n bytes at a place; ValueError where the file ends before."""
        if at + n > self.size:
            raise ValueError("container is cut short")
        if not self.begin <= at or at + n > self.begin + len(self.held):
            self.f.seek(at)
            self.begin, self.held = at, self.f.read(max(n, BLOCK))
        return self.held[at - self.begin : at - self.begin + n]

    def head(self, at: int) -> tuple[str, int, int]:
        """An entry's name, the place after its head, and its payload's length."""
        n, length = struct.unpack("<IQ", self.take(at, 12))
        return self.take(at + 12, n).decode(), at + 12 + n, length


def heads(f: pa.NativeFile, size: int, grouped_magic: bytes = b"") -> Iterator[tuple]:
    """(ord, name, at, length, error) of an open container's entries, in order; the last one may tell an error, without a name where the
    container itself is wrong."""
    b, k, name = Blocks(f, size), 0, None
    try:
        if grouped_magic and size >= len(grouped_magic) and b.take(0, len(grouped_magic)) == grouped_magic:
            first = len(grouped_magic) + 4
            (count,) = struct.unpack("<I", b.take(first - 4, 4))
            end = first
            for _ in range(count):  # where the payloads begin
                _, end, _ = b.head(end)
            at, place = first, end
            for k in range(count):
                name, at, length = b.head(at)
                if place + length > size:
                    raise ValueError("payload is cut short")
                yield k, name, place, length, None
                place, name = place + length, None
        else:
            magic, version, head, count, total = struct.unpack(HEAD_FORM, b.take(0, HEAD_BYTES))
            if magic != MAGIC or version != VERSION or head < HEAD_BYTES:
                raise ValueError("not a container of a known version")
            place, seen = head, 0
            for k in range(count):
                name, at, length = b.head(place)
                if at + length > size:
                    raise ValueError("payload is cut short")
                yield k, name, at, length, None
                place, seen, name = at + length, seen + length, None
            if seen != total:
                raise ValueError("sizes of payloads do not add up")
        if place != size:
            raise ValueError("container has bytes too many")
    except (ValueError, UnicodeDecodeError) as e:
        yield k if name is not None else None, name, None, None, str(e)


def index_containers(files: DataFrame, grouped_magic: bytes = b"") -> DataFrame:
    """(file, ord, name, at, length, error): where each payload of the containers (file, size) lies. No payload is read. A container's
    heads are read by one task, as each tells where the next is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                fs, place = open_store(file)
                with fs.open_input_file(place) as f:
                    for row in heads(f, size, grouped_magic):
                        rows.append((file, *row))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX)

    dealt = files.select("file", "size").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), "file")
    return dealt.mapInArrow(run, "file string, ord long, name string, at long, length long, error string")


def read_entries(index: DataFrame) -> DataFrame:
    """(file, ord, name, data, error) of rows of an index, all or those that a query is after; damaged ones have no data. Entries are dealt out one by
    one, whatever container they are of."""
    schema = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows, held = [], 0
            for file, ord_, name, at, length, error in zip(*(c.to_pylist() for c in batch.columns)):
                data = None
                if error is None:
                    if file != opened:
                        if f is not None:
                            f.close()
                        fs, place = open_store(file)
                        opened, f = file, fs.open_input_file(place)
                    f.seek(at)
                    data = f.read(length)
                    error = None if len(data) == length else "payload is cut short"
                rows.append((file, ord_, name, data, error))
                held += length or 0
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if f is not None:
            f.close()

    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = index.select("file", "ord", "name", "at", "length", "error").repartition(n, "file", "ord").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "file string, ord long, name string, data binary, error string")
