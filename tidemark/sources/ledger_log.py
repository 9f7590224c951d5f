"""A ledger as sorted runs: what a batch adds is a run of its own, and a batch opens only the files that may hold its paths.

A run's files are sorted by path. Beside them stands a table with a row for each file: its least and greatest path, its entries, and a Bloom
filter of the hashes of its paths. A manifest, replaced as a whole, names the runs that count. Of a path's entries that of the newest run counts.
With more than MOST_RUNS runs an append merges them into one. A batch that runs again replaces its own run; files of a crashed task or append are in no
table or no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_store

LEDGER = "bundle_path string, hash string"
MOST_RUNS = 8
#: Bits of a filter for each entry, and probes: about one miss in a hundred is let through.
BITS, PROBES = 10, 7
#: Paths of a batch whose hashes are asked of the filters (8 MB of them); of a larger batch only the range of its paths is.
MOST_ASKED = 1 << 20
ROWS_PER_FILE = 1_000_000


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype("u8", copy=False)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype="u8") * step[:, None]) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, BITS * len(hashes) + 7 & ~7)
    table = np.zeros(bits, bool)
    table[_places(hashes.view("u8"), bits).ravel()] = True
    return np.packbits(table).tobytes()


def may_hold(table: bytes, hashes: np.ndarray) -> bool:
    """Whether a filter lets one of the hashes through."""
    packed = np.frombuffer(table, "u1")
    for k in range(0, len(hashes), 1 << 16):
        at = _places(hashes[k : k + (1 << 16)].view("u8"), 8 * len(packed))
        if (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))) & 1).all(1).any():
            return True
    return False


class LedgerLog:
    """The ledger in a folder, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: Files that the last call of known() reads, and those that the ledger has.
        self.opened = self.files = 0

    def runs(self) -> list[dict]:
        """The runs that count (number, folder), the oldest first."""
        fs, root = open_store(self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/manifest", allow_not_found=True))
        names = sorted(x.path for x in found if x.base_name.endswith(".json"))
        if not names:
            return []
        with fs.open_input_stream(names[-1]) as f:
            return json.loads(f.read())

    def _commit(self, runs: list[dict]) -> None:
        fs, root = open_store(self.path)
        folder = f"{root}/manifest"
        fs.create_dir(folder, recursive=True)
        names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.endswith(".json"))
        number = int(names[-1].rpartition("/")[2][:-5]) + 1 if names else 0
        with fs.open_output_stream(unfinished := f"{folder}/.{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps(sorted(runs, key=lambda r: r["number"])).encode())
        fs.move(unfinished, f"{folder}/{number:012d}.json")
        for old in names[:-1]:  # the last one may still be read
            fs.delete_file(old)

    def _write(self, rows: DataFrame, folder: str) -> None:
        root_uri = f"{self.path.rstrip('/')}/{folder}"

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_store(root_uri)
            fs.create_dir(root, recursive=True)
            held: list[pa.RecordBatch] = []
            out = []

            def put() -> None:
                table = pa.Table.from_batches(held)
                name = f"{uuid.uuid4().hex}.parquet"
                pq.write_table(table.select(["bundle_path", "hash"]), f"{root}/{name}", filesystem=fs)
                out.append({"file": name, "least": table["bundle_path"][0].as_py(), "greatest": table["bundle_path"][-1].as_py(), "n": table.num_rows, "bloom": bloom(table["h"].to_numpy())})
                held.clear()

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= ROWS_PER_FILE:
                    put()
            if any(b.num_rows for b in held):
                put()
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("least", pa.string()), ("greatest", pa.string()), ("n", pa.int64()), ("bloom", pa.binary())]))

        dealt = rows.select("bundle_path", "hash", F.xxhash64("bundle_path").alias("h")).repartitionByRange("bundle_path").sortWithinPartitions("bundle_path")
        dealt.mapInArrow(write, "file string, least string, greatest string, n long, bloom binary").write.mode("overwrite").parquet(f"{root_uri}/stats")

    def append(self, rows: DataFrame, number: int) -> None:
        """Add rows (bundle_path, hash; a path once, not null) as the run of that number, in place of one that has it."""
        folder = f"run-{number:012d}-{uuid.uuid4().hex[:8]}"
        self._write(rows, folder)
        old = self.runs()
        runs = [r for r in old if r["number"] != number] + [{"number": number, "folder": folder}]
        self._commit(runs)
        self._drop([r for r in old if r["number"] == number])
        if len(runs) > MOST_RUNS:
            self.merge()

    def merge(self) -> None:
        """Make one run of all, that of the newest number."""
        runs = self.runs()
        if len(runs) > 1:
            folder = f"run-{runs[-1]['number']:012d}-{uuid.uuid4().hex[:8]}"
            self._write(self.newest(), folder)
            self._commit([{"number": runs[-1]["number"], "folder": folder}])
            self._drop(runs)

    def _drop(self, runs: list[dict]) -> None:
        fs, root = open_store(self.path)
        for r in runs:
            fs.delete_dir(f"{root}/{r['folder']}")

    def _stats(self, before: int | None) -> DataFrame | None:
        runs = [r for r in self.runs() if before is None or r["number"] < before]
        out = None
        for r in runs:
            s = self.spark.read.parquet(f"{self.path}/{r['folder']}/stats").select(F.lit(r["number"]).cast("long").alias("run"), F.concat(F.lit(f"{self.path}/{r['folder']}/"), "file").alias("file"), "least", "greatest", "bloom")
            out = s if out is None else out.unionByName(s)
        return out

    def _read(self, files: list[tuple[int, str]]) -> DataFrame:
        """The newest entry of each path in some files (run, file)."""
        if not files:
            return self.spark.createDataFrame([], LEDGER)
        rows = None
        for run in sorted({r for r, _ in files}):
            part = self.spark.read.schema(LEDGER).parquet(*[f for r, f in files if r == run]).withColumn("run", F.lit(run))
            rows = part if rows is None else rows.unionByName(part)
        return rows.groupBy("bundle_path").agg(F.max_by("hash", "run").alias("hash"))

    def newest(self, before: int | None = None) -> DataFrame:
        """(bundle_path, hash) of all runs, or of those before a number."""
        stats = self._stats(before)
        return self._read([tuple(r) for r in stats.select("run", "file").collect()] if stats is not None else [])  # a row for each file

    def known(self, paths: DataFrame, before: int | None = None) -> DataFrame:
        """(bundle_path, hash) of the files that may hold a path of paths (bundle_path): of those paths, each entry is there."""
        stats = self._stats(before)
        self.opened = self.files = 0
        if stats is None:
            return self.spark.createDataFrame([], LEDGER)
        asked = paths.select("bundle_path").where("bundle_path IS NOT NULL").distinct()
        least, greatest, n = asked.agg(F.min("bundle_path"), F.max("bundle_path"), F.count("*")).first()
        self.files = stats.count()
        if not n:
            return self.spark.createDataFrame([], LEDGER)
        some = stats.where((F.col("greatest") >= least) & (F.col("least") <= greatest))
        if n <= MOST_ASKED:
            hashes = np.array([r.h for r in asked.select(F.xxhash64("bundle_path").alias("h")).collect()], "i8")  # MOST_ASKED at most
            shared = self.spark.sparkContext.broadcast(hashes)

            @F.arrow_udf("boolean")
            def lets_through(tables: pa.Array) -> pa.Array:
                return pa.array([may_hold(t.as_py(), shared.value) for t in tables], pa.bool_())

            some = some.where(lets_through("bloom"))
        files = [tuple(r) for r in some.select("run", "file").collect()]  # a row for each file
        self.opened = len(files)
        return self._read(files)
