"""Sinks: ledgers, manifests and upload plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import public_read
from ..functions.values import lookup
from .catalog import ledger_versions

# Content types by extension.
CONTENT_TYPES = {"json": "application/json", "png": "image/png", "jpg": "image/jpeg", "webp": "image/webp", "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "mp4": "video/mp4", "txt": "text/plain"}


def write_ledger(ledger: DataFrame, path: str) -> None:
    """One row for each path, as a Parquet table sorted by path. Each call writes a version beside the one there, which counts only once
    it is whole, and then drops those before the last: a crash at any moment leaves a whole one, and readers of the last keep it."""
    spark = ledger.sparkSession
    versions = ledger_versions(spark, path)
    target = f"{path}/version={versions[-1] + 1 if versions else 0}"
    ledger.select("bundle_path", "hash").repartitionByRange("bundle_path").sortWithinPartitions("bundle_path").write.mode("overwrite").parquet(target)
    for old in versions[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_ledger_json(ledger: DataFrame, path: str) -> None:
    """For readers of the map format: a map of one entry a line, in order of path, in any number of files. read_ledger reads them back."""
    ledger.orderBy("bundle_path").select(F.to_json(F.create_map("bundle_path", "hash")).alias("value")).write.mode("overwrite").text(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """A JSON line for each exported object, added to those there."""
    rows.select("path", "asset_type", "name", "container", "payload_kind", "suggested_extension").write.mode("append").json(path)


def uploads(files: DataFrame, targets: list[tuple[str, str]], public: list[str]) -> DataFrame:
    """A row for each file at each target (name and prefix, from the configuration), with key, content type and ACL."""
    acl = F.when(public_read(F.col("path"), public), "public-read").otherwise("private")
    kind = F.coalesce(lookup(F.lower(F.substring_index("path", ".", -1)), CONTENT_TYPES), F.lit("application/octet-stream"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(p).alias("prefix")) for t, p in targets]))
    return files.select("path", each.alias("t")).select("path", "t.*").select("target", F.concat_ws("/", "prefix", "path").alias("key"), "path", kind.alias("content_type"), acl.alias("acl"))
