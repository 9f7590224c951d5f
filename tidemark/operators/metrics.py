"""Metrics: maps merged by key, counts by kind, plan statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, metrics: str, keys: list[str], prefix: str = "") -> DataFrame:
    """keys, metric, value: a row for each entry of a map column."""
    return rows.select(*keys, F.explode(metrics).alias("metric", "value")).withColumn("metric", F.concat(F.lit(prefix + "." if prefix else ""), F.col("metric")))


def merged(rows: DataFrame, metrics: str, keys: list[str], prefix: str = "", how=F.sum) -> DataFrame:
    """keys and metrics, the map of each key's sum (or how) over all rows; sums are made before the shuffle."""
    sums = exploded(rows, metrics, keys, prefix).groupBy(*keys, "metric").agg(how("value").alias("value"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))  # one entry for each name


def last_written(value: Column, at: Column) -> Column:
    return F.max_by(value, at)


def or_else(value: Column, other: Column) -> Column:
    """A value, or the other if it is 0 or null."""
    return F.coalesce(F.nullif(value, F.lit(0)), other)


def kind_counts(reads: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Of successful reads, how many and how many bytes by payload kind."""
    return reads.where("success").groupBy(*keys, "payload_kind").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


def plan_statistics(reads: DataFrame) -> DataFrame:
    """One row for each bundle: planned, read, failed and skipped objects, batches, bytes and time."""
    return reads.groupBy("bundle").agg(
        F.count("*").alias("planned"), F.count_if("success").alias("successful"), F.count_if(~F.col("success") & F.col("skipped").isNull()).alias("failed"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"),
        F.count_distinct("batch").alias("batches"), F.coalesce(F.sum(F.when(F.col("success"), F.col("payload_len"))), F.lit(0)).alias("bytes"), F.sum("duration_ms").alias("duration_ms"),
    )
