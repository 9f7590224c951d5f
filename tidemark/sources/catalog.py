"""Catalogues: encrypted files to one row for each bundle; ledgers; file listings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import category
from .catalog_split import PIECE, RANGE, entry_pieces, plain_ranges
from .files import open_store
from .ledger_json import read_maps
from .messagepack import map_head, packed, unpack
from .ranges import SPLIT, file_list

ROW = "bundle_name string, hash string, crc long, file_size long, category string, dependencies array<string>, paths array<string>, is_builtin boolean, download_path string"
LEDGER = "bundle_path string, hash string"


ROWS = pa.schema([("bundle_name", pa.string()), ("hash", pa.string()), ("crc", pa.int64()), ("file_size", pa.int64()), ("category", pa.string()), ("dependencies", pa.list_(pa.string())), ("paths", pa.list_(pa.string())), ("is_builtin", pa.bool_()), ("download_path", pa.string()), ("file", pa.string()), ("place", pa.int64())])


def _bundles(file: str, place: int, entries: int, data: bytes) -> Iterator[dict]:
    at = 0
    for _ in range(entries):
        where = place + at
        name, at = unpack(data, at)
        x, at = unpack(data, at)
        yield {
            "bundle_name": name, "hash": x.get("hash") or "", "crc": x.get("crc"), "file_size": x.get("fileSize"), "category": x.get("category"), "dependencies": x.get("dependencies") or [],
            "paths": x.get("paths") or [], "is_builtin": x.get("isBuiltin"), "download_path": x.get("downloadPath"), "file": file, "place": where,
        }


def decode(pieces: DataFrame) -> DataFrame:
    """Pieces of entries (file, place, entries, data) to one row for each bundle, with its file and its place there. Null strings become
    empty; the map's key names the bundle. Pieces are dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_pylist(list(_bundles(*piece)), schema=ROWS)

    n = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = pieces.select("file", "place", "entries", "data").repartition(n, "file", "place").mapInArrow(run, f"{ROW}, file string, place long")
    return rows.withColumn("category", category(F.col("category")))


def read_catalogues(spark: SparkSession, path: str, key: str | None = None, iv: str | None = None, size: int = RANGE, piece: int = PIECE) -> DataFrame:
    """The bundles of a catalogue file, or of those in a folder, decrypted if a key is given, each decoded by many tasks. Of entries of a
    file that share a name the last counts."""
    rows = decode(entry_pieces(plain_ranges(file_list(spark, path), key, iv, size), piece))
    names = [c for c in rows.columns if c not in ("bundle_name", "file", "place")]
    last = rows.groupBy("file", "bundle_name").agg(F.max_by(F.struct(*names), "place").alias("x"))
    return last.select("bundle_name", "x.*").select(*[c.split()[0] for c in ROW.split(", ")])


def write_catalogues(bundles: DataFrame, folder: str) -> DataFrame:
    """Write bundles (file, bundle_name, hash, crc, file_size, category) as plain catalogue files, one for each file, and return (file, entries);
    they are written when that is evaluated. Rows without a file are left out. An entry at a time is held, not a file; a map's size stands before
    it, so a window counts it first. The window also keeps a file's rows in one task: a repartition by file behind a join by file is optimised
    away, and the join may leave its partitions when it turns into a broadcast."""
    of = W.partitionBy("file").orderBy("bundle_name").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = bundles.where("file IS NOT NULL").select("file", F.count("*").over(of).alias("entries"), "bundle_name", "hash", "crc", "file_size", "category")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        done, last, f, unfinished = [], None, None, ""

        def finish() -> None:
            if f is not None:
                f.close()
                fs.move(unfinished, f"{root}/{last}")

        for batch in batches:
            for file, n, name, digest, crc, size, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if file != last:
                    finish()
                    last, unfinished = file, f"{root}/.{file}.{uuid.uuid4().hex}"
                    f = fs.open_output_stream(unfinished, compression=None)
                    f.write(map_head(2) + packed("version") + packed("1") + packed("bundles") + map_head(n))
                    done.append({"file": file, "entries": n})
                f.write(packed(name) + packed({"hash": digest, "crc": crc, "fileSize": size, "category": kind}))
        finish()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("entries", pa.int64())]))

    return rows.sortWithinPartitions("file", "bundle_name").mapInArrow(write, "file string, entries long")


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_ledger(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """JSON maps of paths to hashes as rows (bundle_path, hash): a file, or the files of a folder, with maps of any layout, one after another
    too. Of a key that repeats the last counts, files in order of name.

    Files are read by byte ranges, so a large one is split among tasks, wherever its lines end. A missing file counts as empty. One that is
    no such map does too, after it was renamed to end with .corrupt: the run goes on and fetches anew.
    """
    fs, place = _hadoop(spark, path)
    if not fs.exists(place):
        return spark.createDataFrame([], LEDGER)
    rows = read_maps(file_list(spark, path), split)
    if not rows.where("error IS NOT NULL").isEmpty():
        kept = spark._jvm.org.apache.hadoop.fs.Path(path + ".corrupt")
        fs.delete(kept, True)
        fs.rename(place, kept)
        return spark.createDataFrame([], LEDGER)
    return rows.groupBy(F.col("key").alias("bundle_path")).agg(F.max_by("value", F.struct("file", "place")).alias("hash"))


def ledger_versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a ledger table, ascending; there are two at most but for a moment."""
    fs, place = _hadoop(spark, path)
    found = [x.getPath() for x in fs.listStatus(place)] if fs.exists(place) else []
    whole = [x.getName() for x in found if x.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.partition("=")[2]) for x in whole)


def read_ledger_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a ledger that write_ledger wrote; empty if there is none."""
    versions = ledger_versions(spark, path)
    return spark.read.schema(LEDGER).parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], LEDGER)


def list_files(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """path and length of all files below a folder; contents are not read. Extensions compare without case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.endswith(F.lower("path"), F.lit("." + extension.lower()))) if extension else files
