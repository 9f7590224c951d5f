"""Row numbers within groups of any size, by a prefix sum over range partitions.

A window puts a whole group into one task. Here rows are dealt out by range of group and order, so a large group is in several partitions in a
row; each task numbers its own, and only a partition's first group may go on from the one before: one offset for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import written


def _changes(batch: pa.RecordBatch, group: list[str], last: list) -> np.ndarray:
    """Which rows differ from the one before in a column of the group; last are the values before the batch."""
    out = np.zeros(batch.num_rows, bool)
    for name, before in zip(group, last):
        column = batch.column(name)
        shifted = pa.concat_arrays([pa.array([before], column.type), column[:-1]])
        same = pc.or_kleene(pc.fill_null(pc.equal(column, shifted), False), pc.and_(column.is_null(), shifted.is_null()))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with a row's number from 1 among those of its group, by order (nulls first); a null in a column of the group is a value of it.

    Rows that agree in group and order meet in one task and are numbered in any way, so order should tell a group's rows apart. The rows are
    written once to the shared folder. What goes to the driver is one row for each partition.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    keys = [*group, *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    own = [pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in df.schema.fields]
    schema = pa.schema([*own, ("_part", pa.int64()), ("_at", pa.int64()), ("_n", pa.int64()), ("_first", pa.bool_())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, run, first, last = TaskContext.get().partitionId(), 0, 0, True, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            changed = _changes(batch, group, last) if last is not None else _changes(batch, group, [batch.column(g)[0].as_py() for g in group])
            index = np.arange(size)
            begins = np.maximum.accumulate(np.where(changed, index, -1))
            n = np.where(begins < 0, run + index + 1, index - begins + 1)
            in_first = (begins < 0) & first
            first, run = first and not changed.any(), int(n[-1])
            last = [batch.column(g)[size - 1].as_py() for g in group]
            more = [pa.array(np.full(size, part), pa.int64()), pa.array(index + seen, pa.int64()), pa.array(n, pa.int64()), pa.array(in_first)]
            seen += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=schema)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    table = written(ranged.mapInArrow(number, f"{ddl}, _part long, _at long, _n long, _first boolean"), "numbered")
    key = F.struct(*[F.col(g) for g in group])
    ends = table.groupBy("_part").agg(F.min_by(key, "_at").alias("head"), F.max_by(key, "_at").alias("tail"), F.max_by("_n", "_at").alias("run"), F.count_if(~F.col("_first")).alias("others"))
    offsets, tail, total = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row for each partition
        before = total if tail is not None and r.head == tail else 0
        if before:
            offsets.append((r["_part"], before))
        tail, total = r.tail, r.run + (0 if r.others else before)
    rest = table.drop("_part", "_at", "_n", "_first").columns
    if not offsets:
        return table.select(*rest, F.col("_n").alias(name))
    joined = table.join(F.broadcast(spark.createDataFrame(offsets, "_part long, _before long")), "_part", "left")
    return joined.select(*rest, (F.col("_n") + F.when(F.col("_first"), F.coalesce("_before", F.lit(0))).otherwise(0)).alias(name))
