"""Duplicates, segments, documents and status lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, segment_key, slashes, without_extension
from ..sources.scratch import written
from .numbering import numbered

SIGNATURE = ("type", "name", "container", "payload_kind", "suggested_extension")


def distinct_outputs(rows: DataFrame) -> DataFrame:
    """rows (path, payload, arrival and SIGNATURE) without repeats: of equal signatures at a path the first stays, others
    there get __dup2, __dup3 and so on in order of arrival.

    Repeats go by aggregation over digests, so payloads are not shuffled; what differs at a path is numbered by range, however many share it. Two
    nulls in the same place of a signature are equal.
    """
    signed = rows.select("path", *SIGNATURE, "arrival", F.sha2("payload", 256).alias("signature"), F.length("payload").cast("long").alias("bytes"))
    first = signed.groupBy("path", *SIGNATURE, "signature").agg(F.min("arrival").alias("arrival"), F.first("bytes").alias("bytes"))
    return numbered(first, ["path"], ["arrival"]).withColumn("output", duplicate_path(F.col("path"), F.col("n"))).drop("n")


def duplicate_path(path: Column, n: Column) -> Column:
    """Where the nth of what differs at a path goes."""
    suffixed = F.concat(without_extension(path), F.lit("__dup"), n.cast("string"), F.coalesce(F.concat(F.lit("."), extension(path)), F.lit("")))
    return F.when(n == 1, path).otherwise(suffixed)


def _joined(parts: Column) -> Column:
    """An array of binaries as one, in time that follows its length."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def merge_segments(files: DataFrame) -> DataFrame:
    """Files (dir, stem, data) whose stems are numbered: a group of more than one that counts 1, 2, .. without a gap is one
    file, other files pass as they are. Columns dir, stem, data, merged (the number of files in it, 0 for a passed one)."""
    base, number = segment_key(F.col("stem"))
    keyed = files.select("dir", "stem", "data", F.coalesce(base, F.col("stem")).alias("_base"), number.alias("_n"), base.isNotNull().alias("_numbered"))
    groups = keyed.groupBy("dir", "_base", "_numbered").agg(F.sort_array(F.collect_list(F.struct("_n", "stem", "data"))).alias("files"))  # the segments of one file
    n = F.size("files")
    numbers = F.transform("files", lambda x: x["_n"])
    whole = F.col("_numbered") & (n > 1) & (F.array_min(numbers) == 1) & (F.array_max(numbers) == n) & (F.size(F.array_distinct(numbers)) == n)
    joined = F.struct(F.col("_base").alias("stem"), _joined(F.transform("files", lambda x: x["data"])).alias("data"), n.cast("long").alias("merged"))
    apart = F.transform("files", lambda x: F.struct(x["stem"].alias("stem"), x["data"].alias("data"), F.lit(0).cast("long").alias("merged")))
    return groups.select("dir", F.inline(F.when(whole, F.array(joined)).otherwise(apart)))


def merge_all(files: DataFrame, suffix: str = ".usm") -> DataFrame:
    """dir, name, data, merged: the files (dir, ord, data) of each folder one after another, whatever their names, under the folder's own
    name. A null data adds nothing."""
    listed = files.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("ord", "data"))).alias("files"))  # the parts of one file
    parts = F.transform("files", lambda x: F.coalesce(x["data"], F.lit(b"").cast("binary")))
    return listed.select("dir", F.concat(F.substring_index("dir", "/", -1), F.lit(suffix)).alias("name"), _joined(parts).alias("data"), F.size("files").cast("long").alias("merged"))


def grouped_documents(objects: DataFrame) -> DataFrame:
    """container, object_count and objects (name, type, data) of objects with a container, those without a name first, then by name and index."""
    named = objects.where(F.trim("container") != "").withColumn("container", slashes(F.col("container")))
    listed = F.sort_array(F.collect_list(F.struct(F.col("name").isNotNull().alias("named"), "name", "index", "type", "data")))  # one document
    return named.groupBy("container").agg(F.count("*").alias("object_count"), F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["data"].alias("data"))).alias("objects"))


def container_route(containers: Column) -> Column:
    """Of an asset's containers: 'many', 'one', 'folder' (several in one folder) or 'none'."""
    files = F.array_distinct(containers)
    folders = F.array_distinct(F.transform(files, lambda p: F.regexp_replace(p, "/[^/]*$", "")))
    return F.when(F.size(files) == 0, "none").when(F.size(files) == 1, "one").when(F.size(folders) == 1, "folder").otherwise("many")


def retain(jobs: DataFrame, keep: int, terminal: Column) -> DataFrame:
    """All running jobs and the newest keep of those that have ended; 0 keeps all. The newest are a top-k, so no task sees all jobs."""
    if not keep:
        return jobs
    return jobs.where(~terminal).unionByName(jobs.where(terminal).orderBy(F.col("updated_at").desc(), "job_id").limit(keep))


def status_lists(jobs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """By a bucket of the caller (column bucket), the ids of each group of statuses, in order."""
    return jobs.groupBy("bucket").agg(*[F.sort_array(F.collect_list(F.when(F.col("status").isin(s), F.col("job_id")))).alias(g) for g, s in groups.items()])


def process_tree_sum(spark, processes: DataFrame, root: int) -> DataFrame:
    """Sum of cpu over a process (pid, ppid, cpu; a pid once) and all below it; a cycle counts once. Null where there is no such process.

    By pointer doubling: each process asks whether the root is among its next 1, 2, 4, .. ancestors, so a chain of n takes log2(n) rounds, each a
    table of its own. Who has met the root or the end of its chain leaves the rounds; who walks in a ring leaves when the steps exceed the processes.
    """
    links = written(processes.where((F.col("pid") != root) & F.col("ppid").isNotNull()).select("pid", F.col("ppid").alias("to"), (F.col("ppid") == root).alias("met")), "links")
    n, steps = links.count(), 1
    while steps <= n and not (walking := links.where("NOT met")).isEmpty():
        further = links.select(F.col("pid").alias("to"), F.col("to").alias("_to"), F.col("met").alias("_met"))
        # Who points to no process of the table has come to the end of its chain and goes.
        moved = walking.join(further, "to").select("pid", F.col("_to").alias("to"), F.col("_met").alias("met"))
        links = written(moved.unionByName(links.where("met")), "links")
        steps *= 2
    found = links.where("met").select("pid").unionByName(processes.where(F.col("pid") == root).select("pid"))
    return processes.join(found, "pid", "left_semi").agg(F.sum("cpu").alias("cpu"))
