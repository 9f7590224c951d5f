"""Incremental planning: from a catalogue, pattern lists and ledgers to an ordered list of tasks.

Relations: catalogue (bundle_name, hash, crc, file_size, category, download_path), ledger (bundle_path, hash), task (see TASK).
Joins name no strategy: the planner broadcasts a ledger if its size allows and else shuffles both sides by path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_match, first_match, included
from ..functions.paths import bundle_file, render

TASK = ("download_path", "bundle_path", "bundle_hash", "category", "file_size", "priority", "export_payloads", "stage_3d")


@dataclass(frozen=True)
class Filters:
    """Pattern lists of a region. by_crc: the checksum stands for the hash and download paths are under download_path."""

    start_app: list[str] = field(default_factory=list)
    on_demand: list[str] = field(default_factory=list)
    skip: list[str] = field(default_factory=list)
    priority: list[str] = field(default_factory=list)
    by_crc: bool = False


def wanted(f: Filters, name: Column, category: Column) -> Column:
    """Not skipped, and matched by the list of its category; an empty list takes nothing."""
    by_category = F.when(category == "StartApp", any_match(name, f.start_app)).when(category.isin("OnDemand", "LivePv"), any_match(name, f.on_demand)).otherwise(False)
    return ~any_match(name, f.skip) & by_category


def as_tasks(catalogue: DataFrame, f: Filters, priority: Column, export: bool, stage: bool) -> DataFrame:
    """Catalogue rows as tasks."""
    digest = F.col("crc").cast("string") if f.by_crc else F.coalesce("hash", F.lit(""))
    download = F.concat_ws("/", "download_path", "bundle_name") if f.by_crc else F.col("bundle_name")
    return catalogue.select(download.alias("download_path"), F.col("bundle_name").alias("bundle_path"), digest.alias("bundle_hash"), "category", "file_size", priority.cast("long").alias("priority"), F.lit(export).alias("export_payloads"), F.lit(stage).alias("stage_3d"))


def not_current(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tasks whose path the ledger does not have with the same hash."""
    known = ledger.select(F.col("bundle_path").alias("_path"), F.coalesce("hash", F.lit("")).alias("_hash"))
    return tasks.join(known, (tasks["bundle_path"] == known["_path"]) & (tasks["bundle_hash"] == known["_hash"]), "left_anti")


def current(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    known = ledger.select(F.col("bundle_path").alias("_path"), F.coalesce("hash", F.lit("")).alias("_hash"))
    return tasks.join(known, (tasks["bundle_path"] == known["_path"]) & (tasks["bundle_hash"] == known["_hash"]), "left_semi")


def plan(catalogue: DataFrame, ledger: DataFrame, f: Filters) -> DataFrame:
    """New and changed bundles that the filters want, unordered. The filter runs before the join, on the scan."""
    chosen = catalogue.where(wanted(f, F.col("bundle_name"), F.col("category")))
    return not_current(as_tasks(chosen, f, first_match(F.col("bundle_name"), f.priority), True, False), ledger)


def plan_staged(catalogue: DataFrame, ledger: DataFrame, f: Filters, include: list[str], exclude: list[str] = (), enabled: bool = True) -> DataFrame:
    """Tasks of the second ledger: without include patterns, or switched off, there are none."""
    chosen = catalogue.where(F.lit(enabled) & included(F.col("bundle_name"), include, list(exclude), empty_means_all=False))
    return not_current(as_tasks(chosen, f, F.lit(None), False, True), ledger)


def staged_in_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("bundle_path")


def prefetch(catalogue: DataFrame, f: Filters, include: list[str] | None, exclude: list[str] = ()) -> DataFrame:
    """Bundles taken as they are, whatever the category and ledgers: an empty list means all, no list none."""
    taken = F.lit(False) if include is None else included(F.col("bundle_name"), include, list(exclude), empty_means_all=True)
    return as_tasks(catalogue.where(taken), f, F.lit(None), False, False)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists with one task for each path: that of least priority number, of equals the first list's, with the flags of all."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    rank = F.struct(F.col("priority").isNull().alias("none"), "priority", "_list")
    best = both.groupBy("bundle_path").agg(F.min_by(F.struct(*[c for c in TASK if c not in ("bundle_path", "export_payloads", "stage_3d")]), rank).alias("t"), F.bool_or("export_payloads").alias("export_payloads"), F.bool_or("stage_3d").alias("stage_3d"))
    return best.select("t.*", "bundle_path", "export_payloads", "stage_3d").select(*TASK)


def in_order(tasks: DataFrame) -> DataFrame:
    """By priority, tasks without one last, then by path in byte order."""
    return tasks.orderBy(F.col("priority").asc_nulls_last(), "bundle_path")


def with_urls(tasks: DataFrame, template: str, **values: Column) -> DataFrame:
    """Tasks with the URL that a template gives; {bundle_path} is the download path."""
    return tasks.withColumn("url", render(template, **values, bundle_path=F.col("download_path")))


def summary(catalogue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: discovered, queued, completed, failed, updated; outcomes are tasks with a boolean ok."""
    seen = catalogue.select(F.lit(True).alias("found"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("boolean").alias("export_payloads"))
    both = seen.unionByName(outcomes.select(F.lit(False).alias("found"), "ok", "export_payloads"))
    return both.agg(F.count_if("found").alias("discovered"), F.count_if(~F.col("found")).alias("queued"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & F.col("export_payloads")).alias("updated"))


def is_total_failure() -> Column:
    """Of a summary: something was queued, nothing completed, something failed."""
    return (F.col("queued") > 0) & (F.col("completed") == 0) & (F.col("failed") > 0)


def chart_hashes(ledger: DataFrame, prefix: str = "music/music_score") -> DataFrame:
    return ledger.where(F.startswith("bundle_path", F.lit(prefix)))


def updated_ledger(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with the paths of completed tasks set to their hashes; entries never go. One shuffle by path."""
    new = done.select("bundle_path", F.col("bundle_hash").alias("hash"), F.lit(1).alias("_new"))
    return ledger.select("bundle_path", "hash", F.lit(0).alias("_new")).unionByName(new).groupBy("bundle_path").agg(F.max_by("hash", F.struct("_new", "hash")).alias("hash"))


def providers(known: DataFrame, selected: DataFrame) -> DataFrame:
    """The storage provider of each selection (column selector) from known (name, scheme and any more): that of the same name, or if there
    is none the unnamed one of that scheme. Selections that repeat are one. The query fails where there is none or more than one. Both are
    configuration, a few rows."""
    asked = selected.select(F.trim("selector").alias("selector")).distinct()
    named = known.withColumn("_key", F.trim(F.coalesce("name", F.lit(""))))
    by_name = asked.join(named.where("_key != ''"), F.col("selector") == F.col("_key")).withColumn("_rank", F.lit(0))
    by_scheme = asked.join(named.where("_key = ''"), F.lower("selector") == F.lower(F.trim("scheme"))).withColumn("_rank", F.lit(1))
    found = by_name.unionByName(by_scheme).groupBy("selector").agg(F.min("_rank").alias("_best"))
    chosen = by_name.unionByName(by_scheme).join(found, "selector").where("_rank = _best")
    counts = asked.join(chosen.groupBy("selector").agg(F.count("*").alias("_n")), "selector", "left")
    one = F.assert_true(F.coalesce("_n", F.lit(0)) == 1, F.concat(F.lit("not exactly one storage provider: "), F.col("selector")))
    sure = counts.where(one.isNull()).select("selector")
    # From the selections, so that the check is not left out where there is no provider at all.
    return sure.join(chosen, "selector", "left").drop("_key", "_rank", "_best")


def staging(tasks: DataFrame, pending: DataFrame, listing: DataFrame) -> DataFrame:
    """What each task (bundle_path) needs before an export from a staging folder, given pending ones (bundle_path) and a listing (path): state
    is ready, missing (pending and not there: an error), placeholder (not pending and not there) or kept."""
    there = listing.select(F.col("path").alias("_there")).distinct()
    asked = pending.select(F.col("bundle_path").alias("_pending")).distinct()
    rows = tasks.withColumn("stored", bundle_file(F.col("bundle_path"))).join(there, F.col("stored") == F.col("_there"), "left").join(asked, F.col("bundle_path") == F.col("_pending"), "left")
    wanted_, found = F.col("_pending").isNotNull(), F.col("_there").isNotNull()
    return rows.withColumn("state", F.when(wanted_ & found, "ready").when(wanted_, "missing").when(found, "kept").otherwise("placeholder")).drop("_there", "_pending")


def is_sparse() -> Column:
    """Of a staging table, as an aggregate: some tasks are not pending, so the folder is marked as sparse."""
    return F.bool_or(F.col("state").isin("kept", "placeholder"))
