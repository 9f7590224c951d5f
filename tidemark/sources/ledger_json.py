"""JSON maps of strings, of any layout and size, read by byte ranges.

Of a map of strings to strings the quotes that are not escaped come in fours: a key's and its value's. So the number of such quotes before
a place, modulo four, tells what stands there, and ranges can be counted by themselves: a first pass counts each range's quotes, sums
by file tell each range where it is, and a second pass takes the entries whose keys begin in a range apart, reading on to the
end of the last one. Each entry checks what stands between its strings and up to the next key, so the ranges check the whole file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import open_store
from .ranges import SPLIT, file_ranges

#: What may stand before the first key, between a key and its value, after a value before the next key, after the last value, and in a file without keys.
#: Maps may follow each other, empty ones too.
BEFORE, COLON = re.compile(rb"(?:\s*\{\s*\})*\s*\{\s*"), re.compile(rb"\s*:\s*")
BETWEEN, AFTER = re.compile(rb"\s*(?:,|\}(?:\s*\{\s*\})*\s*\{)\s*"), re.compile(rb"\s*\}(?:\s*\{\s*\})*\s*")
NOTHING = re.compile(rb"(?:\s*\{\s*\})*\s*")
CONTROL = re.compile(rb"[\x00-\x1f]")
READ_ON = 1 << 16


class Damaged(ValueError):
    """A file that is no map of strings."""


def quotes(data: bytes, slashes_before: int = 0) -> np.ndarray:
    """Places of the quotes in data that are not escaped, slashes_before backslashes standing right before data."""
    a = np.frombuffer(data, "u1")
    at = np.flatnonzero(a == 34)
    slash = a == 92
    if not len(at) or not slashes_before and not slash.any():
        return at
    # The last place before each that is no backslash; the run of backslashes before a quote begins behind it.
    plain = np.maximum.accumulate(np.where(slash, -1 - slashes_before, np.arange(len(a))))
    last = np.where(at > 0, plain[np.maximum(at - 1, 0)], -1 - slashes_before)
    return at[(at - 1 - last) % 2 == 0]


def slashes_before(f: pa.NativeFile, at: int) -> int:
    n = 0
    while at > n:
        take = min(READ_ON, at - n)
        f.seek(at - n - take)
        piece = f.read(take)
        run = len(piece) - len(piece.rstrip(b"\\"))
        n += run
        if run < take:
            break
    return n


def string(raw: bytes) -> str:
    """A JSON string's content."""
    try:
        if b"\\" in raw:
            out = json.loads(b'"' + raw + b'"')
            out.encode()
            return out
        if CONTROL.search(raw):
            raise Damaged("control character in a string")
        return raw.decode()
    except (ValueError, UnicodeError) as e:
        raise Damaged(str(e)) from e


def entries(f: pa.NativeFile, size: int, begin: int, end: int, quotes_before: int) -> Iterator[tuple[str, str, int]]:
    """(key, value, place) of the entries whose keys begin in [begin, end) of an open file; Damaged where what is checked here is wrong."""
    f.seek(begin)
    data, before, step = f.read(end - begin), slashes_before(f, begin), READ_ON
    found = quotes(data, before)
    first = -quotes_before % 4  # of the quotes here, the first that begins a key

    def missing() -> bool:
        own = len(found[found < end - begin]) - first
        if own <= 0:
            return begin == 0 and not len(found)
        return len(found) <= first + 4 * -(-own // 4)  # up to the next key

    while missing() and begin + len(data) < size:
        f.seek(begin + len(data))
        data, step = data + f.read(step), 2 * step
        found = quotes(data, before)
    if begin == 0 and not (BEFORE if len(found) else NOTHING).fullmatch(data[: found[0]] if len(found) else data):
        raise Damaged("no map begins the file")
    at = found.tolist()
    for j in range(first, len(at), 4):
        if at[j] >= end - begin:
            break
        if j + 3 >= len(at):
            raise Damaged("the file ends within an entry")
        a, b, c, d = at[j : j + 4]
        last = j + 4 >= len(at)
        gap = data[d + 1 :] if last else data[d + 1 : at[j + 4]]
        if not COLON.fullmatch(data, b + 1, c) or not (gap == b"," or (AFTER if last else BETWEEN).fullmatch(gap)) or last and gap == b",":
            raise Damaged(f"unexpected content near byte {begin + b}")
        yield string(data[a + 1 : b]), string(data[c + 1 : d]), begin + a


def read_maps(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(key, value, file, place, error) of files (file, size) of JSON maps of strings: a row for each entry, or one with an error for each range
    where a file is no such map."""
    ranges = file_ranges(files, split)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fs, place = open_store(r["file"])
                with fs.open_input_file(place) as f:
                    before = slashes_before(f, r["begin"])
                    f.seek(r["begin"])
                    out.append(r | {"n": len(quotes(f.read(r["end"] - r["begin"]), before))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("k", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("n", pa.int64())]))

    counted = ranges.mapInArrow(count, "file string, size long, k int, begin long, end long, n long")
    # Rows of a window: the ranges of a file.
    known = counted.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    dealt = known.select("file", "size", "begin", "end", "before").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), "file", "begin")
    schema = pa.schema([("key", pa.string()), ("value", pa.string()), ("file", pa.string()), ("place", pa.int64()), ("error", pa.string())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple] = []
                fs, place = open_store(r["file"])
                with fs.open_input_file(place) as f:
                    try:
                        for key, value, at in entries(f, r["size"], r["begin"], r["end"], r["before"]):
                            rows.append((key, value, r["file"], at, None))
                            if len(rows) >= 20_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                                rows = []
                    except Damaged as e:
                        rows.append((None, None, r["file"], r["begin"], str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return dealt.mapInArrow(take, "key string, value string, file string, place long, error string")
