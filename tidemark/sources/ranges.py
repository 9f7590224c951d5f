"""Byte ranges of files, for readers whose tasks share a file."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_store

SPLIT = 16 << 20


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of a file, or of the files right in a folder but for those whose names start with a dot or _. None where nothing is."""
    fs, place = open_store(path)
    info = fs.get_file_info(place)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))
    prefix = path[: len(path) - len(place)] if path.endswith(place) else "file:" if path.startswith("file:") else ""
    rows = [(prefix + x.path, x.size) for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
    return spark.createDataFrame(rows, "file string, size long")


def file_ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(file, size, k, begin, end): the files in ranges of split bytes, dealt out evenly; an empty file is one range."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))
    rows = files.select("file", "size", F.posexplode(starts).alias("k", "begin")).withColumn("end", F.least(F.col("begin") + split, F.col("size")))
    return rows.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), "file", "k")
