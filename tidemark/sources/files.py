"""Files that tasks write themselves, each whole or not at all: bundles, payloads, documents, and what they are made of."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import deobfuscate
from ..functions.paths import bundle_file, extension, file_name, safe_entry, slashes, with_extension, without_extension
from ..operators.grouping import SIGNATURE, distinct_outputs
from ..operators.objects import routes
from ..operators.planning import is_sparse
from .containers import entries, pixels, png

WRITTEN = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    if "://" in uri and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row of files (path, data) below root and return path, bytes and sha256 of each as a DataFrame; the files are
    written when it is evaluated. A file appears under its name once it is whole, so a task that runs again replaces
    it by the same. A null data is an empty file; rows that share a path must have the same data. Rows are dealt out as they come."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        made: set[str] = set()
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py() or b""
                target = f"{base}/{path}"
                folder, name = posixpath.split(target)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(unfinished := f"{folder}/.{name[:100]}.{uuid.uuid4().hex}", compression=None) as f:
                    f.write(data)
                fs.move(unfinished, target)
                rows.append((path, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), WRITTEN.types)], schema=WRITTEN)

    return files.select("path", "data").mapInArrow(write, "path string, bytes long, sha256 string")


def bundle_files(bundles: DataFrame) -> DataFrame:
    """(path, data) of bundles (bundle_path, content): without their masks, at their places. An unsafe path fails the query."""
    place = F.coalesce(bundle_file(F.col("bundle_path")), F.raise_error(F.concat(F.lit("unsafe bundle path: "), F.col("bundle_path"))).cast("string"))
    return bundles.select(place.alias("path"), deobfuscate(F.col("content")).alias("data"))


def staged_index(bundles: DataFrame) -> DataFrame:
    """The ledger of staged bundles (bundle_path, content): bundle_path with slashes, hash of the content without its mask."""
    return bundles.select(slashes(F.col("bundle_path")).alias("bundle_path"), F.sha2(deobfuscate(F.col("content")), 256).alias("hash"))


def entry_place(target: Column, entry: Column) -> Column:
    """Where an entry of a payload of several files goes: in a folder beside the target that has its stem."""
    stem = without_extension(file_name(target))
    folder = F.when(F.contains(target, F.lit("/")), F.regexp_replace(target, "[^/]*$", "")).otherwise("")
    return F.concat(folder, F.when(stem == "", "asset").otherwise(stem), F.lit("/"), safe_entry(entry))


def fan_out(images: DataFrame, formats: list[str]) -> DataFrame:
    """A row for each image (target) and different format, with path, where it goes."""
    each = F.explode(F.array_distinct(F.array(*[F.lit(f) for f in formats]))).alias("format")
    paths = F.coalesce(*[F.when(F.col("format") == f, with_extension(F.col("target"), f)) for f in dict.fromkeys(formats)])
    return images.select("*", each).withColumn("path", paths)


EXPANDED = pa.schema([("target", pa.string()), ("entry", pa.string()), ("form", pa.string()), ("data", pa.binary()), ("error", pa.string())])


def _expanded(route: str, kind: str | None, target: str, payload: bytes) -> list[tuple]:
    try:
        if route == "several":
            return [(target, name, "entry", data, None) for name, data in entries(payload)]
        if route == "image" and kind == "image_raw_rgba":
            return [(target, None, "png", png(*pixels(payload)), None)]
        return [(target, None, "whole", payload, None)]
    except (ValueError, UnicodeDecodeError) as e:
        return [(target, None, "png" if route == "image" else "whole", None, str(e))]


def payload_files(reads: DataFrame) -> DataFrame:
    """(path, data, error) of reads (type, payload_kind, target, payload): nothing for empty and unsupported ones, the entries of payloads of
    several files, raw pixels of images as PNG, all others as they are, archives of text assets and payloads without a kind too. error tells what
    could not be parsed. One pass over the reads."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):  # one payload's files at a time
                files = _expanded(*row)
                if files:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), EXPANDED.types)], schema=EXPANDED)

    routed = reads.select(routes(F.col("payload_kind"), F.col("payload"), F.col("target"), F.col("type")).alias("route"), "payload_kind", "target", "payload").where("route != 'skip'")
    rows = routed.mapInArrow(expand, "target string, entry string, form string, data binary, error string")
    place = F.when(F.col("form") == "entry", entry_place(F.col("target"), F.col("entry"))).when(F.col("form") == "png", with_extension(F.col("target"), "png")).otherwise(F.col("target"))
    return rows.select(place.alias("path"), "data", "error")


def claimed_reads(reads: DataFrame) -> DataFrame:
    """reads (target, payload, arrival, and the columns of a signature) without those that repeat one at the same target, and without empty and
    unsupported ones; others that share a target have their own, with a suffix. arrival names a read. Payloads do not meet: only their digests do."""
    reads = reads.where(routes(F.col("payload_kind"), F.col("payload"), F.col("target"), F.col("type")) != "skip")
    keyed = reads.select(F.col("target").alias("path"), "payload", "arrival", *SIGNATURE)
    claims = distinct_outputs(keyed).select(F.col("arrival").alias("_arrival"), "output")
    return reads.join(claims, reads["arrival"] == claims["_arrival"]).withColumn("target", F.col("output")).drop("_arrival", "output")


def manifest_rows(reads: DataFrame, written: DataFrame) -> DataFrame:
    """What a manifest tells of the files that were written (path, as payload_files names them): path and the signature of the read at whose
    target, or in whose folder, a file lies. Reads that share a target must have been claimed before."""
    keys = reads.select(*SIGNATURE, F.explode(F.array_distinct(F.array(F.col("target"), with_extension(F.col("target"), "png")))).alias("_at"))
    several = reads.where(F.startswith("payload_kind", F.lit("image_array_bundle_")) | (F.col("payload_kind") == "animator_bundle_fbx"))
    folders = several.select(*SIGNATURE, F.concat(without_extension(F.col("target")), F.lit("/")).alias("_in"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    inside = written.where(F.size(parts) > 1).select("path", F.explode(above).alias("_in"))
    single = written.join(keys, written["path"] == keys["_at"]).select("path", *SIGNATURE)
    return single.unionByName(inside.join(folders, "_in").select("path", *SIGNATURE)).distinct().withColumnRenamed("type", "asset_type")


#: Name of the file that marks a staging folder in which some bundles are placeholders.
SPARSE = ".sparse-input"


def staging_files(states: DataFrame) -> DataFrame:
    """(path, data) of a staging table (stored, state): an empty file for each placeholder, and the marker where not all tasks are pending.
    A task that is pending but missing fails the query."""
    missing = F.raise_error(F.concat(F.lit("missing staged bundle: "), F.col("stored"))).cast("boolean")
    absent = F.when(F.col("state") == "missing", missing).otherwise(F.col("state") == "placeholder")
    empty = F.lit(b"").cast("binary").alias("data")
    marker = states.agg(is_sparse().alias("sparse")).where("sparse").select(F.lit(SPARSE).alias("path"), empty)
    return states.where(absent).select(F.col("stored").alias("path"), empty).unionByName(marker)


def document_files(documents: DataFrame) -> DataFrame:
    """(path, data) of grouped documents (container, object_count, objects): one JSON file each, whose name ends with json."""
    place = F.when(extension(F.col("container")).isNull(), F.concat("container", F.lit(".json"))).otherwise(with_extension(F.col("container"), "json"))
    body = F.to_json(F.struct("container", "object_count", "objects"), {"pretty": "true", "ignoreNullFields": "false"})
    return documents.select(safe_entry(place).alias("path"), F.encode(body, "UTF-8").alias("data"))
