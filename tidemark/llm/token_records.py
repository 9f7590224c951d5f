"""Token-id records in binary files, with an offset index beside each for shuffled reads.

Data file: records one after another. A record frames its payload as
    length u64 | masked CRC-32 of the length u32 | payload | masked CRC-32 of the payload u32
and its payload is
    flags u8 (1: no doc_id, 2: ids are 16 bits wide) | doc_id i64 | number of ids u32 | ids
all little-endian. A mask (rotate right by 15, add a constant) keeps checksums of data that hold checksums apart.
Index file: for each record its place in the data file u64 and the ids before it in that file u64.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import in_arrow, materialise, open_store, parallelism, scratch_dir, text_or_empty
from .tokens import encoder

NO_ID, NARROW = 1, 2
HEAD, ROOM, TAIL = struct.Struct("<QI"), struct.Struct("<BqI"), struct.Struct("<I")
MASK_ADD = 0xA282EAD8
#: Records that one read task takes from a file.
READ_RECORDS = 4096
MANIFEST = "part long, file string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 65536
    body = ROOM.pack((doc_id is None) * NO_ID | narrow * NARROW, doc_id or 0, len(ids)) + ids.astype("<u2" if narrow else "<u4").tobytes()
    size = struct.pack("<Q", len(body))
    return size + TAIL.pack(masked(size)) + body + TAIL.pack(masked(body))


def unframe(data: bytes, at: int, where: str = "") -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the place after the record; ValueError if a checksum does not hold."""
    size, crc = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError(f"the length at {at} of {where} is damaged")
    at += HEAD.size
    body = data[at : at + size]
    if len(body) < size or masked(body) != TAIL.unpack_from(data, at + size)[0]:
        raise ValueError(f"the record at {at} of {where} is damaged")
    flags, doc_id, n = ROOM.unpack_from(body)
    ids = np.frombuffer(body, "<u2" if flags & NARROW else "<u4", n, ROOM.size).astype("<u4")
    return (None if flags & NO_ID else doc_id), ids, at + size + TAIL.size


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write them in ascending doc_id, nulls first; return the manifest of files.

    A null text counts as empty, an empty one holds the end id alone. Rows of one doc_id keep the order of the input;
    so that no doc_id has to fit one task, they are dealt out by their place in the input too. Other columns are
    not read. File part k holds what sorts before part k + 1. The manifest names the files of the attempts that
    counted; a file that a lost task left is in none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(partitions or parallelism(spark), "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        at = tokens = records = 0
        with fs.open_output_stream(f"{root}/{name}.rec") as data, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(enc.encode(text.as_py()) + end, "<u4")
                    record = frame(doc_id, ids)
                    index.write(struct.pack("<QQ", at, tokens))
                    data.write(record)
                    at, tokens, records = at + len(record), tokens + len(ids), records + 1
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "records": records, "tokens": tokens, "bytes": at}] if records else [], schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    return materialise(in_arrow(rows, write, MANIFEST), "token-manifest")


def read_records(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The records of a manifest's files: doc_id, start (ids in all files before it), n_tokens, ids_crc32 and, if asked for, ids.

    Tasks take runs of records through the index, in any order and on any machine.
    """
    # One row for each file; a file is a task's output, so this window is over few rows.
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    runs = files.select("file", "records", "bytes", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(READ_RECORDS).cast("long"))).alias("first"))
    runs = runs.repartition(parallelism(manifest.sparkSession), "file", "first")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for run in batch.to_pylist():
                last = min(run["first"] + READ_RECORDS, run["records"])
                with fs.open_input_file(f"{root}/{run['file']}.idx") as f:
                    f.seek(16 * run["first"])
                    index = np.frombuffer(f.read(16 * (last + 1 - run["first"])), "<u8").reshape(-1, 2)
                stop = int(index[last - run["first"], 0]) if last < run["records"] else run["bytes"]
                out: list[list] = [[] for _ in kinds]
                held = 0
                with fs.open_input_file(f"{root}/{run['file']}.rec") as f:
                    for k in range(last - run["first"]):
                        at = int(index[k, 0])
                        f.seek(at)
                        end = int(index[k + 1, 0]) if k + 1 < last - run["first"] else stop
                        doc_id, ids, _ = unframe(f.read(end - at), 0, run["file"])
                        for column, value in zip(out, (doc_id, run["base"] + int(index[k, 1]), len(ids), zlib.crc32(ids), ids)):
                            column.append(value)
                        held += len(ids) * with_ids
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds)], names=[n for n, _ in kinds])
                            out, held = [[] for _ in kinds], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds)], names=[n for n, _ in kinds])

    return in_arrow(runs, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op2_token_records(spark, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """All documents written as records, then read back from the files."""
    import public_tokenizers

    folder = scratch_dir(spark, "token-records")
    manifest = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return read_records(manifest, folder, with_ids=False)
