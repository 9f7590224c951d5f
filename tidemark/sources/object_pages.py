"""Object tables in pages: a sink that writes them and a Spark data source that reads only the pages that a query asks for.

A file has pages, each an Arrow stream of so many objects in order, then an index, then the index's length and a magic number. The index has
for each page its place and length, its least and greatest object index, and its types and names (of names the least and
the greatest). Tasks plan by shares of files: the driver lists files and never opens one. A task reads a file's index, takes the pages of its share
that the pushed filters leave, and reads those ranges alone.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .files import open_store

SCHEMA = "bundle string, index long, name string, container string, type string, path_id long, unique_id string, size long"
COLUMNS = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in SCHEMA.split(", "))])
MAGIC, TAIL, TAIL_BYTES = b"OBJPAGE1", "<I8s", 12
PAGE = 1000
#: Bytes of a file for each partition of a scan.
SHARE = 16 << 20


def write_object_pages(objects: DataFrame, folder: str, page: int = PAGE) -> DataFrame:
    """Write objects (the columns of SCHEMA), a file for each partition, and return (file, pages, objects); files are written when that is
    evaluated. A page is held in memory, not a file. Sort by what queries filter on for pages that filters can tell apart."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.pages"
        index, rows, at = [], [], 0
        held: list[pa.RecordBatch] = []

        def put(f, table: pa.Table) -> None:
            nonlocal at
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, COLUMNS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            body = sink.getvalue()
            f.write(body)
            least, names = pc.min_max(table["index"]).as_py(), pc.min_max(table["name"]).as_py()
            kinds = pc.unique(table["type"]).to_pylist()
            index.append({"at": at, "bytes": len(body), "n": table.num_rows, "index": [least["min"], least["max"]], "name": [names["min"], names["max"]], "types": kinds})
            at += len(body)

        with fs.open_output_stream(unfinished := f"{root}/.{name}", compression=None) as f:
            n = 0
            for batch in batches:
                held.append(pa.RecordBatch.from_arrays(batch.columns, schema=COLUMNS))
                n += batch.num_rows
                if n >= page:
                    table = pa.Table.from_batches(held, COLUMNS)
                    whole = n - n % page
                    for k in range(0, whole, page):
                        put(f, table.slice(k, page))
                    held, n = table.slice(whole).to_batches(), n % page
            if n:
                put(f, pa.Table.from_batches(held, COLUMNS))
            tail = json.dumps(index).encode()
            f.write(tail + struct.pack(TAIL, len(tail), MAGIC))
        if index:
            fs.move(unfinished, f"{root}/{name}")
            rows = [{"file": name, "pages": len(index), "objects": sum(p["n"] for p in index)}]
        else:
            fs.delete_file(unfinished)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("pages", pa.int64()), ("objects", pa.int64())]))

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return objects.select(*names).mapInArrow(write, "file string, pages long, objects long")


def read_index(f: pa.NativeFile, size: int) -> list[dict]:
    """The index of an open file of pages; ValueError if it is none or cut short."""
    if size < TAIL_BYTES:
        raise ValueError("file of pages is too short")
    f.seek(size - TAIL_BYTES)
    n, magic = struct.unpack(TAIL, f.read(TAIL_BYTES))
    if magic != MAGIC or n > size - TAIL_BYTES:
        raise ValueError("not a file of pages")
    f.seek(size - TAIL_BYTES - n)
    return json.loads(f.read(n))


def _kept(page: dict, filters: list[Filter]) -> bool:
    """Whether a page may have a row that all filters let through."""
    for f in filters:
        column = f.attribute[0]
        if column == "type":
            values = set(f.value if isinstance(f, In) else [f.value])
            if not values & set(page["types"]):
                return False
            continue
        low, high = page[column]
        if low is None:  # nulls alone
            return False
        if isinstance(f, (EqualTo, In)):
            if not any(low <= v <= high for v in (f.value if isinstance(f, In) else [f.value]) if v is not None):
                return False
        elif isinstance(f, StringStartsWith):
            if high < f.value or low[: len(f.value)] > f.value:
                return False
        elif isinstance(f, GreaterThan) and not high > f.value or isinstance(f, GreaterThanOrEqual) and not high >= f.value:
            return False
        elif isinstance(f, LessThan) and not low < f.value or isinstance(f, LessThanOrEqual) and not low <= f.value:
            return False
    return True


def _mask(batch: pa.RecordBatch, f: Filter) -> pa.Array:
    column = batch.column(f.attribute[0])
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type))
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, f.value)
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
    return compare[type(f)](column, pa.scalar(f.value, column.type))


class Share(InputPartition):
    """Pages begin to end (of all shares of a file, as parts of its bytes) of one file."""

    def __init__(self, path: str, size: int, share: int, shares: int):
        self.path, self.size, self.share, self.shares = path, size, share, shares


class ObjectPagesReader(DataSourceReader):
    def __init__(self, folder: str, share: int):
        self.folder, self.share, self.filters = folder, share, []
        self.pages_read = self.bytes_read = 0  # of this process

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of index, equality and lists of type and name, and starts of name are done here; Spark does the others."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            by_value = isinstance(f, (EqualTo, In)) and column in ("type", "name", "index") and (isinstance(f, In) or f.value is not None)
            by_range = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and column in ("index", "name")
            if by_value or by_range or isinstance(f, StringStartsWith) and column == "name":
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = open_store(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        out = []
        for x in sorted(files, key=lambda x: x.path):
            if x.type == pafs.FileType.File and x.base_name.endswith(".pages") and not x.base_name.startswith("."):
                shares = max(1, -(-x.size // self.share))
                out += [Share(posixpath.basename(x.path), x.size, k, shares) for k in range(shares)]
        return out

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, root = open_store(self.folder)
        with fs.open_input_file(f"{root}/{partition.path}") as f:
            pages = read_index(f, partition.size)
            first, last = (partition.size * k // partition.shares for k in (partition.share, partition.share + 1))
            for p in pages:
                if first <= p["at"] < last and _kept(p, self.filters):
                    f.seek(p["at"])
                    body = f.read(p["bytes"])
                    self.pages_read, self.bytes_read = self.pages_read + 1, self.bytes_read + len(body)
                    for batch in pa.ipc.open_stream(body):
                        for g in self.filters:
                            batch = batch.filter(_mask(batch, g))
                        if batch.num_rows:
                            yield batch


class ObjectPages(DataSource):
    """Format object_pages. Options: path, a folder of write_object_pages; share, bytes for each partition."""

    @classmethod
    def name(cls) -> str:
        return "object_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectPagesReader:
        return ObjectPagesReader(self.options["path"], int(self.options.get("share", SHARE)))


def read_object_pages(spark: SparkSession, folder: str, share: int = SHARE) -> DataFrame:
    """The objects of a folder of pages. Registers the source and lets Spark push filters to it, for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectPages)
    return spark.read.format("object_pages").option("share", share).load(folder)
