"""Files of any size from their parts: sorted, and written as they stream by.

A part is a row (path, at, data): at orders the parts of a file. Parts are dealt out by path and sorted, and the task of a path writes them one after
another, so it holds a batch of parts, never a file or an array of parts. What stands before the parts and needs sums over them, such as a container's
head, is made by an aggregation without their data and becomes a part itself.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import to_little_endian
from ..functions.paths import extension, safe_entry, segment_key, slashes, with_extension
from ..operators.numbering import numbered
from .containers import HEAD_BYTES, MAGIC, VERSION
from .files import WRITTEN, open_store

#: Bytes of a batch of parts that goes to Python, but for a longer part.
BATCH_BYTES = 4 << 20


def write_composed(parts: DataFrame, root: str) -> DataFrame:
    """Write files from parts (path, at, data) below root and return path, bytes and sha256 of each; they are written when that is evaluated. A file
    appears once it is whole; a null data adds nothing. Parts of a file that agree in at go by their data."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        last, f, digest, size, unfinished = None, None, None, 0, ""

        def finish() -> pa.RecordBatch:
            f.close()
            fs.move(unfinished, f"{base}/{last}")
            return pa.RecordBatch.from_pylist([{"path": last, "bytes": size, "sha256": digest.hexdigest()}], schema=WRITTEN)

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if path != last:
                    if f is not None:
                        yield finish()
                    folder, name = posixpath.split(f"{base}/{path}")
                    fs.create_dir(folder, recursive=True)
                    last, digest, size, unfinished = path, hashlib.sha256(), 0, f"{folder}/.{name[:100]}.{uuid.uuid4().hex}"
                    f = fs.open_output_stream(unfinished, compression=None)
                piece = data.as_buffer() if data.is_valid else b""
                f.write(piece)
                digest.update(piece)
                size += len(piece)
        if f is not None:
            yield finish()

    parts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ordered = parts.repartition("path").sortWithinPartitions("path", "at", "data").select("path", "data")
    return ordered.mapInArrow(write, "path string, bytes long, sha256 string")


def segment_parts(files: DataFrame) -> DataFrame:
    """(path, at, data, merged) of files (dir, stem, data): of a group of more than one whose numbers count 1, 2, .. without a gap all are parts of
    one file, others are files of one part (merged 0). Groups are judged by aggregation over stems, without data."""
    base, number = segment_key(F.col("stem"))
    keyed = files.select("dir", "stem", "data", F.coalesce(base, F.col("stem")).alias("_base"), number.alias("_n"), base.isNotNull().alias("_numbered"))
    counts = keyed.where("_numbered").groupBy("dir", "_base").agg(F.count("*").alias("n"), F.min("_n").alias("least"), F.max("_n").alias("most"), F.count_distinct("_n").alias("different"))
    whole = counts.where("n > 1 AND least = 1 AND most = n AND different = n").select(F.col("dir").alias("_dir"), F.col("_base").alias("_of"), "n")
    rows = keyed.join(whole, F.col("_numbered") & (F.col("dir") == F.col("_dir")) & (F.col("_base") == F.col("_of")), "left")
    stem = F.when(F.col("n").isNull(), F.col("stem")).otherwise(F.col("_base"))
    return rows.select(F.concat_ws("/", "dir", stem).alias("path"), F.coalesce("_n", F.lit(0)).alias("at"), "data", F.coalesce("n", F.lit(0)).alias("merged"))


def _bytes(c: Column) -> Column:
    return F.coalesce(c, F.lit(b"").cast("binary"))


def container_parts(rows: DataFrame, grouped_magic: bytes = b"") -> DataFrame:
    """(path, at, data): for each path the parts of the container of its rows (path, ord, name, data) in order of ord: interleaved, or grouped
    behind grouped_magic. A null data has no bytes but keeps its name. Sums for the head are made without the data."""
    name, size = F.encode("name", "UTF-8"), F.length(_bytes(F.col("data")))
    head = F.concat(to_little_endian(F.length(name), 4), to_little_endian(size, 8), name)
    at = lambda phase: F.struct(F.lit(phase).alias("phase"), "ord").alias("at")
    sums = rows.select("path", F.col("ord"), size.cast("long").alias("size")).groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("ord").alias("ord"))
    if grouped_magic:
        front = F.concat(F.lit(grouped_magic), to_little_endian(F.col("n"), 4))
        bodies = rows.select("path", at(1), head.alias("data")).unionByName(rows.select("path", at(2), _bytes(F.col("data")).alias("data")))
    else:
        front = F.concat(F.lit(struct.pack("<IHH", MAGIC, VERSION, HEAD_BYTES)), to_little_endian(F.col("n"), 4), to_little_endian(F.col("total"), 8))
        bodies = rows.select("path", at(1), F.concat(head, _bytes(F.col("data"))).alias("data"))
    return sums.select("path", at(0), front.alias("data")).unionByName(bodies)


def folder_parts(files: DataFrame, suffix: str = ".usm") -> DataFrame:
    """(path, at, data): the files (dir, ord, data) of each folder one after another, whatever their names, under the folder's own name."""
    return files.select(F.concat("dir", F.lit("/"), F.substring_index("dir", "/", -1), F.lit(suffix)).alias("path"), F.col("ord").alias("at"), "data")


def document_parts(objects: DataFrame) -> DataFrame:
    """(path, at, data): one JSON document for each container, with container, object_count and objects (name, type, data), those without a name
    first, then by name and index. An object is a part; a document's front and end are parts."""
    named = objects.where(F.trim("container") != "").withColumn("container", slashes(F.col("container"))).withColumn("named", F.col("name").isNotNull())
    placed = numbered(named.select("container", "named", "name", "index", "type", "data"), ["container"], ["named", "name", "index"])
    place = F.when(extension(F.col("container")).isNull(), F.concat("container", F.lit(".json"))).otherwise(with_extension(F.col("container"), "json"))
    text = F.to_json(F.struct("name", "type", "data"), {"ignoreNullFields": "false"})
    body = placed.select(safe_entry(place).alias("path"), F.col("n").alias("at"), F.encode(F.concat(F.when(F.col("n") > 1, ",\n").otherwise(""), text), "UTF-8").alias("data"))
    sums = named.groupBy("container").agg(F.count("*").alias("n"))
    front = F.concat(F.lit('{"container":'), F.get(F.split(F.to_json(F.array("container")), r"^\[|\]$"), F.lit(1)), F.lit(',"object_count":'), F.col("n").cast("string"), F.lit(',"objects":[\n'))
    ends = [sums.select(safe_entry(place).alias("path"), at.alias("at"), F.encode(t, "UTF-8").alias("data")) for at, t in ((F.lit(0).cast("long"), front), (F.col("n") + 1, F.lit("\n]}\n")))]
    return body.unionByName(ends[0]).unionByName(ends[1])
