"""Catalogue files of any size, decoded by many tasks.

A catalogue is one encrypted MessagePack map that holds a map of bundles. Its ciphertext is read by ranges and each range decrypted by itself: in
a chain of blocks a range needs the ciphertext block before it, and, as the cipher's padding is checked, one block behind it that decrypts to
padding. A first pass goes over the plain ranges in order and skips values without building them, to cut the map into pieces of whole
entries; then the pieces are dealt out and decoded. No task holds a decoded map, and none but the first pass a whole file, that one a range
and an entry at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import check_key
from .files import open_store
from .messagepack import map_size, skip, unpack
from .ranges import file_ranges

#: Bytes of a range (whole blocks of the cipher), and of a piece.
RANGE, PIECE = 1 << 20, 1 << 18
BLOCK = 16
PIECES = pa.schema([("file", pa.string()), ("place", pa.int64()), ("entries", pa.int64()), ("data", pa.binary())])


def plain_ranges(files: DataFrame, key: str | None, iv: str | None, size: int = RANGE) -> DataFrame:
    """(file, k, data): files (file, size) in ranges, decrypted if a key is given. A file whose size is no positive multiple of a block fails
    the query then, as a wrong key does where the last range's padding comes out wrong."""
    if size % BLOCK:
        raise ValueError("a range has whole blocks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, place = open_store(r["file"])
                before = min(BLOCK, r["begin"])
                with fs.open_input_file(place) as f:
                    f.seek(r["begin"] - before)
                    data = f.read(before + r["end"] - r["begin"])
                columns = {"file": [r["file"]], "k": [r["k"]], "ends": [r["end"] == r["size"]], "whole": [r["size"]], "before": [data[:before]], "data": [data[before:]]}
                yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("file", pa.string()), ("k", pa.int32()), ("ends", pa.bool_()), ("whole", pa.int64()), ("before", pa.binary()), ("data", pa.binary())]))

    rows = file_ranges(files, size).mapInArrow(read, "file string, k int, ends boolean, whole long, before binary, data binary")
    if not key:
        return rows.select("file", "k", "data")
    check_key(key, iv)
    secret, cbc, pkcs = F.unhex(F.lit(key)), F.lit("CBC"), F.lit("PKCS")
    last = F.substring("data", -BLOCK, BLOCK)
    padding = F.substring(F.aes_encrypt(F.lit(b""), secret, cbc, pkcs, last), BLOCK + 1, BLOCK)
    first = F.when(F.length("before") == 0, F.unhex(F.lit(iv))).otherwise(F.col("before"))
    cipher = F.concat(first, "data", F.when(F.col("ends"), F.lit(b"")).otherwise(padding))
    sound = F.assert_true((F.col("whole") > 0) & (F.col("whole") % BLOCK == 0), F.lit("encrypted content must be a positive multiple of 16 bytes"))
    return rows.where(sound.isNull()).select("file", "k", F.aes_decrypt(cipher, secret, cbc, pkcs).alias("data"))


class Cutter:
    """Takes a catalogue's bytes in order and gives pieces of whole bundle entries: (place, entries, bytes)."""

    def __init__(self, piece: int):
        self.piece, self.data, self.begin, self.at = piece, b"", 0, 0
        self.pairs: int | None = None
        self.bundles = 0

    def feed(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        self.data, self.begin, self.at = self.data[self.at :] + data, self.begin + self.at, 0
        start, n = 0, 0
        try:
            while self.pairs is None or self.pairs or self.bundles:
                if self.bundles:
                    if not n:
                        start = self.at
                    self.at = skip(self.data, skip(self.data, self.at))
                    self.bundles -= 1
                    n += 1
                    if self.at - start >= self.piece or not self.bundles:
                        yield self.begin + start, n, self.data[start : self.at]
                        n = 0
                elif self.pairs is None:
                    self.pairs, self.at = map_size(self.data, self.at)
                else:
                    value = skip(self.data, self.at)
                    if unpack(self.data, self.at)[0] == "bundles":
                        self.bundles, self.at = map_size(self.data, value)
                    else:
                        self.at = skip(self.data, value)
                    self.pairs -= 1
        except IndexError:  # a value goes on in the next range
            pass
        if n:
            yield self.begin + start, n, self.data[start : self.at]

    def end(self) -> None:
        if self.pairs is None or self.pairs or self.bundles:
            raise ValueError("MessagePack ends within a value")


def entry_pieces(ranges: DataFrame, piece: int = PIECE) -> DataFrame:
    """(file, place, entries, data): the bundles of catalogues in pieces of whole entries, from plain ranges. A file's ranges go through
    one task in order, as nothing in MessagePack tells where a value begins."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, of = None, None
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if cutter is None or file != of:
                    if cutter is not None:
                        cutter.end()
                    cutter, of = Cutter(piece), file
                for place, n, body in cutter.feed(data.as_py()):
                    yield pa.RecordBatch.from_pydict({"file": [file], "place": [place], "entries": [n], "data": [body]}, schema=PIECES)
        if cutter is not None:
            cutter.end()

    ordered = ranges.repartition("file").sortWithinPartitions("file", "k").select("file", "data")
    return ordered.mapInArrow(cut, "file string, place long, entries long, data binary")
