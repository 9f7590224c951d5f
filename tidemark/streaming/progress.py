"""Job progress: updates to events, a batch fold, and its streaming twin with state for each job.

Update rows: job_id, at (timestamp), seq (order within equal times), update_type, bundle, n, message.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.grouping import SIGNATURE, duplicate_path
from ..sources.ledger_log import LedgerLog

#: Events that a job keeps.
RECENT = 20
TERMINAL = ("completed", "failed", "cancelled")
# Phase and message of each update; {0} is the bundle, {1} the number, {2} the text. None makes no event.
EVENTS = {
    "Phase": (None, "{2}"), "DownloadsPlanned": ("planning_downloads", "planned {1} bundle download(s)"), "BundleStarted": ("downloading_bundles", "downloading bundle `{0}`"),
    "BundleDownloaded": ("downloading_bundles", "downloaded bundle `{0}` ({1} bytes)"), "BundleTempWritten": ("downloading_bundles", "wrote bundle `{0}` temp file in {1} ms"), "BundleExported": ("downloading_bundles", "exported bundle `{0}` in {1} ms"),
    "BundleCompleted": ("downloading_bundles", "completed bundle `{0}`"), "BundleFailed": ("downloading_bundles", "failed bundle `{0}`: {2}"), "RecordSaved": ("persisting_state", "saved downloaded asset record with {1} entries"),
}
SILENT = ("BundleFetchDetails", "BundleDeobfuscated", "SchedulerTelemetry")
OUTPUT = "job_id string, phase string, total long, completed long, failed long, status string, at timestamp, recent array<string>"


def to_events(updates: DataFrame) -> DataFrame:
    """Updates with their phase and message; silent ones have none."""
    kind = F.col("update_type")
    phase, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (p, text) in EVENTS.items():
        out = F.lit(text)
        for k, c in enumerate(("bundle", "n", "message")):
            out = F.replace(out, F.lit("{%d}" % k), F.coalesce(F.col(c).cast("string"), F.lit("")))
        phase = F.when(kind == name, F.lit(p) if p else F.col("bundle")).otherwise(phase)
        message = F.when(kind == name, out).otherwise(message)
    return updates.withColumns({"phase": phase, "text": message})


def fold(updates: DataFrame) -> DataFrame:
    """One row for each job: what its updates come to. Those after a cancellation do not count; a job that has completed or failed
    stays so, but for a cancellation.

    Counts are aggregates, made before the shuffle; the newest events are kept by a bounded top-k for each job.
    """
    cut = updates.groupBy("job_id").agg(F.min(F.when(F.col("update_type") == "Cancelled", F.struct("at", "seq"))).alias("cut")).where("cut IS NOT NULL")
    kept = updates.join(cut.withColumnRenamed("job_id", "_job"), F.col("job_id") == F.col("_job"), "left").where(F.col("cut").isNull() | (F.struct("at", "seq") <= F.col("cut")))
    kind, when = F.col("update_type"), F.struct("at", "seq")
    events = to_events(kept)
    counts = events.groupBy("job_id").agg(
        F.max_by(F.when(kind == "DownloadsPlanned", F.col("n")), F.when(kind == "DownloadsPlanned", when)).alias("total"), F.count_if(kind == "BundleCompleted").alias("completed"), F.count_if(kind == "BundleFailed").alias("failed"),
        F.max_by("phase", F.when(F.col("text").isNotNull(), when)).alias("phase"), F.max("at").alias("updated_at"), F.bool_or(kind == "Cancelled").alias("cancelled"),
        F.min_by(F.lower(kind), F.when(kind.isin("Completed", "Failed"), when)).alias("ended"),
    )
    counts = counts.withColumn("status", F.when(F.col("cancelled"), "cancelled").otherwise(F.coalesce("ended", F.lit("running"))))
    return counts.select("job_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "completed", "failed", "phase", "updated_at", F.coalesce("cancelled", F.lit(False)).alias("cancelled"), "status")


def recent(updates: DataFrame, keep: int = RECENT) -> DataFrame:
    """The newest events of each job, numbered from the newest. The planner keeps a top-k before the shuffle."""
    newest = F.row_number().over(W.partitionBy("job_id").orderBy(F.col("at").desc(), F.col("seq").desc()))
    return to_events(updates).where("text IS NOT NULL").withColumn("place", newest).where(F.col("place") <= keep).select("job_id", "place", "at", "phase", "text")


class JobFold(StatefulProcessor):
    """A job's snapshot as a value and its newest lines as a list. What a batch adds is summed up by columns, a chunk of rows at a time; chunks of
    a job with more than one wait in a file of the task, as a cancellation in the last may undo rows of the first."""

    COUNTS = {"BundleCompleted": "completed", "BundleFailed": "failed"}

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", "phase string, total long, completed long, failed long, status string, at timestamp")
        self.lines = handle.getListState("recent", "line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        old = self.snapshot.get() if self.snapshot.exists() else ("", 0, 0, 0, "running", None)
        if old[4] == "cancelled":
            for _ in rows:  # late updates do not count
                pass
            return
        with tempfile.TemporaryFile() as spool:
            cut, chunks = None, self._spooled(rows, spool)
            first = next(chunks, None)
            held = [first] if first is not None else []
            for chunk in [first, *chunks] if first is not None else []:
                own = chunk.loc[chunk.update_type == "Cancelled", ["at", "seq"]]
                if len(own):
                    least = tuple(own.sort_values(["at", "seq"]).iloc[0])
                    cut = least if cut is None else min(cut, least)
            new = Sums(old)
            for chunk in self._again(spool, held):
                new.add(chunk if cut is None else chunk[(chunk["at"] < cut[0]) | (chunk["at"] == cut[0]) & (chunk["seq"] <= cut[1])])
        value = new.snapshot(cut is not None)
        lines = ([x[0] for x in self.lines.get()] + new.texts())[-RECENT:]
        self.snapshot.update(value)
        if lines:
            self.lines.put([(x,) for x in lines])
        if self.keep_ms is not None and value[4] in TERMINAL and old[4] not in TERMINAL:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame([(key[0], *value, lines)], columns=["job_id", "phase", "total", "completed", "failed", "status", "at", "recent"])

    @staticmethod
    def _spooled(rows: Iterator[pd.DataFrame], spool) -> Iterator[pd.DataFrame]:
        """The chunks, all but the first also written to spool."""
        writer = None
        for k, chunk in enumerate(rows):
            chunk = chunk[["at", "seq", "update_type", "n", "phase", "text"]]
            if k:
                table = pa.RecordBatch.from_pandas(chunk, SPOOLED, preserve_index=False)
                writer = writer or pa.ipc.new_stream(spool, SPOOLED)
                writer.write_batch(table)
            yield chunk
        if writer:
            writer.close()

    @staticmethod
    def _again(spool, held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from held
        if spool.tell():
            spool.seek(0)
            for batch in pa.ipc.open_stream(spool):
                yield batch.to_pandas()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.snapshot.clear()
        self.lines.clear()
        yield from ()

    def close(self) -> None:
        pass


SPOOLED = pa.schema([("at", pa.timestamp("ns")), ("seq", pa.int64()), ("update_type", pa.string()), ("n", pa.float64()), ("phase", pa.string()), ("text", pa.string())])


class Sums:
    """What chunks of a job's updates add to a snapshot, whatever their order."""

    def __init__(self, old: tuple):
        self.phase, self.total, self.completed, self.failed, self.status, self.at = old
        self.planned, self.ended, self.recent = None, None, None

    def add(self, chunk: pd.DataFrame) -> None:
        kind = chunk.update_type
        self.completed += int((kind == "BundleCompleted").sum())
        self.failed += int((kind == "BundleFailed").sum())
        if len(chunk):
            at = chunk["at"].max()
            self.at = at if self.at is None or at > pd.Timestamp(self.at) else self.at
        planned = chunk[kind == "DownloadsPlanned"].sort_values(["at", "seq"]).tail(1)
        if len(planned):
            found = (planned["at"].iloc[0], planned["seq"].iloc[0], int(planned["n"].iloc[0]))
            self.planned = found if self.planned is None else max(self.planned, found)
        ended = chunk[kind.isin(["Completed", "Failed"])].sort_values(["at", "seq"]).head(1)
        if len(ended):
            found = (ended["at"].iloc[0], ended["seq"].iloc[0], ended["update_type"].iloc[0].lower())
            self.ended = found if self.ended is None else min(self.ended, found)
        told = chunk[chunk["text"].notna()]
        told = told if self.recent is None else pd.concat([self.recent, told])
        self.recent = told.sort_values(["at", "seq"]).tail(RECENT)

    def snapshot(self, cancelled: bool) -> tuple:
        status = "cancelled" if cancelled else self.status if self.status in TERMINAL else self.ended[2] if self.ended else self.status
        phase = self.recent["phase"].iloc[-1] if self.recent is not None and len(self.recent) else self.phase
        return phase, self.planned[2] if self.planned else self.total, self.completed, self.failed, status, self.at

    def texts(self) -> list[str]:
        return [] if self.recent is None else self.recent["text"].tolist()


#: The state store that values, lists, maps and timers need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold_stream(updates: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of updates as snapshots of each job that changed, with state for each job. Sets the session's state store. Within a batch updates count
    in their order, batches one after another. A job's state goes keep_ms of processing time after it has ended, if given; else it stays."""
    updates.sparkSession.conf.set(*ROCKS)
    mode = "None" if keep_ms is None else "ProcessingTime"
    return to_events(updates).groupBy("job_id").transformWithStateInPandas(JobFold(keep_ms), OUTPUT, "Update", mode)


class Claims(StatefulProcessor):
    """Of a path: the signatures that have claimed it, each with its number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getMapState("claims", "signature string", "n long")
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = None
        for chunk in rows:  # what is held is a row for each different signature
            chunk = chunk[["signature", "arrival"]]
            new = (chunk if new is None else pd.concat([new, chunk])).groupby("signature", as_index=False)["arrival"].min()
        n = self.last.get()[0] if self.last.exists() else 0
        out = []
        for signature, arrival in new.sort_values("arrival").itertuples(index=False) if new is not None else ():
            if not self.claims.containsKey((signature,)):
                n += 1
                self.claims.updateValue((signature,), (n,))
                out.append((key[0], int(arrival), n))
        self.last.update((n,))
        yield pd.DataFrame(out, columns=["path", "arrival", "n"])

    def close(self) -> None:
        pass


def claim_stream(rows: DataFrame) -> DataFrame:
    """A streaming DataFrame of outputs (path, payload, arrival and a signature's columns) as those that are new: path, arrival, output. As distinct_outputs, but
    claims of earlier batches, and of earlier runs of the query, stand: numbers of suffixes go on. Sets the session's state store."""
    rows.sparkSession.conf.set(*ROCKS)
    whole = F.to_json(F.struct(*SIGNATURE, F.sha2("payload", 256).alias("_payload")), {"ignoreNullFields": "false"})
    signed = rows.select("path", F.sha2(whole, 256).alias("signature"), F.col("arrival").cast("long").alias("arrival"))
    claimed = signed.groupBy("path").transformWithStateInPandas(Claims(), "path string, arrival long, n long", "Append", "None")
    return claimed.select("path", "arrival", duplicate_path(F.col("path"), F.col("n")).alias("output"))


def incremental(catalogues: DataFrame, ledger_path: str, plan: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that plans each batch of new catalogue rows against the ledger log at ledger_path, hands the tasks to sink and then
    appends them to the log as the run of that batch; there need be no log yet. A batch opens only files that may hold its paths. The newest entry of a path
    counts. A batch that runs again after a failure plans against the runs before its own and replaces its own; sink gets the
    batch's number to do likewise."""

    def run(batch: DataFrame, number: int) -> None:
        log = LedgerLog(batch.sparkSession, ledger_path)
        known = log.known(batch.select(F.col("bundle_name").alias("bundle_path")), number)
        tasks = plan(batch, known).persist()
        sink(tasks, number)
        log.append(tasks.groupBy("bundle_path").agg(F.max("bundle_hash").alias("hash")), number)
        tasks.unpersist()

    return catalogues.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of a snapshot that a list of jobs shows.
LISTED = ("id", "parent_job_id", "kind", "region", "status", "dry_run", "asset_version", "asset_hash", "message", "created_at", "updated_at")


def job_list(snapshots: DataFrame) -> DataFrame:
    """Snapshots as a list shows them, the newest first."""
    return snapshots.select(*LISTED).orderBy(F.col("created_at").desc(), "id")


def can_finish(status: Column) -> Column:
    """Whether a job may still fail or complete."""
    return ~status.isin(*TERMINAL)
