"""Scratch tables and files in the folder that the cluster shares, and small helpers of the operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on one machine (tests), a temporary one set for the session.
    ValueError on a cluster without it: executors would not see a local folder of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, kind: str) -> str:
    return f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"


#: With this, Spark drops an execution's shuffle files when it ends. What materialise writes is read from its table from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, kind)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if (tables := _tables.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, tables of materialise() are temporary: at the end they are deleted, but for those given to the function that this yields."""
    own: list[str] = []
    outer = _tables.set(own)

    def keep(df: DataFrame) -> DataFrame:
        own.pop()  # the one just made
        return df

    try:
        yield keep
    finally:
        _tables.reset(outer)
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for a join in which no side is to be broadcast. The planner takes exploded rows, and what repeats within a file, for as
    small as the file they come from: it would send them whole through the driver, many times its threshold."""
    return df.hint("merge")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or plain path, for files that tasks write and read themselves."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def parent(path: str) -> str:
    return posixpath.dirname(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of a batch that goes to Python. Counted in rows alone, a batch of long texts would have no bound that is small.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_BYTES (a longer row is one by itself)."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose count is set by hand: what the session would use itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
