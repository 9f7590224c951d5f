"""Best-fit packing of documents into training sequences.

The lengths' histogram has one bin for each length up to the capacity, whatever the number of documents. On it the
driver solves the configuration linear program (fewest sequences, each a multiset of lengths that fits, such that
every length is covered) by multiplicative weights: uncovered lengths weigh more, and a knapsack dynamic program
finds the configuration of greatest weight. The solution is rounded down; what is left over goes by best fit, with
equal bins held as one group. The documents stay distributed: each piece has a rank among those of its length, and
a rank names its place in the plan.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import in_arrow, materialise, open_store, scratch_dir, text_or_empty
from .tokens import encoder

ROUNDS = 240
#: Rounding keeps configurations at least this full; pieces of others go by best fit with the rest.
FULL = 0.995
LEARNING = 0.35
#: A length's ranks lie in a span of the key of a place.
SPAN = 1 << 50


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Tokenise docs (doc_id, text) and cut those over capacity; a shared-folder table of one row for each piece.

    A null text counts as empty; each document ends with end_id, so an empty one is a piece of one id. Only the
    first of several pieces may be shorter than capacity. part and part_rank place a piece among those of
    its length: part is the task that made it, part_rank its number there. Other columns are not read.
    """
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("part_rank", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, "<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b]), part, seen[b - a], ids[a:b].astype("i4"))
                    seen[b - a] += 1
                    for column, value in zip(out, row):
                        column.append(value)
                held += len(ids) * with_ids
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                    out, held = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialise(in_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, part_rank long" + ", ids array<int>" * with_ids), "pieces")


def best_configuration(worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of greatest worth that fits: an unbounded knapsack. worth[l] is 0 where no length l is."""
    lengths = np.flatnonzero(worth)
    value, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    w = worth[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if n := upto[c]:
            got = value[c - lengths[:n]] + w[:n]
            k = int(got.argmax())
            if got[k] > value[c]:
                value[c], took[c] = got[k], lengths[k]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, learning: float = LEARNING) -> list[tuple[dict[int, int], float]]:
    """An approximate solution of the configuration program by multiplicative weights: configurations and how often.

    A length's dual price starts at its part of the capacity. Each round takes the configuration of greatest worth at
    these prices as often as covers a part of the scarcest length in it; then a length that is covered less than the
    mean multiplies its price up, one that is covered more multiplies it down. The prices' running mean converges to
    the program's dual, and the taken configurations, divided by the least cover, to its solution.
    """
    present = np.flatnonzero(counts)
    covered, steps = np.zeros(capacity + 1), []
    price = np.zeros(capacity + 1)
    price[present] = present / capacity
    part = max(0.02, min(1.0, 4.0 * len(present) / rounds / 8))
    for k in range(rounds):
        config = best_configuration(price, capacity)
        times = part * min(counts[l] / a for l, a in config.items())
        for l, a in config.items():
            covered[l] += a * times
        steps.append((config, times))
        share = covered[present] / counts[present]
        gap = share - np.average(share, weights=present * counts[present])
        price[present] = present / capacity * np.exp(-learning * np.clip(gap / max(part, share.max()), -1, 1))
    top = max(1e-9, float((covered[present] / counts[present]).max()))
    return [(config, times / top) for config, times in steps]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit of the longest first over a histogram; bins with equal contents are one group with a count."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    for l in map(int, np.flatnonzero(counts)[::-1]):
        n = int(counts[l])
        while n:
            fits = [r for r in room if r >= l]
            if not fits:
                each = min(capacity // l, n)
                groups, n = [([l] * each, n // each)], n % each
            else:
                r = min(fits)
                held, m = room[r].pop()
                each = min(r // l, n)
                take = min(m, n // each)
                if m > take:
                    room[r].append((held, m - take))
                if not room[r]:
                    del room[r]
                groups, n = [(held + [l] * each, take)], n - each * take
            for held, m in groups:
                room.setdefault(capacity - sum(held), []).append((held, m))
    return [group for groups in room.values() for group in groups]


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Contents (longest first) of the sequences and how many have them, for counts[l] pieces of each length l."""
    left = counts.astype(np.int64).copy()
    plan = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    if left.any():
        for config, times in sorted(fractional(left, capacity), key=lambda x: -x[1]):
            m = min(int(times), *(int(left[l]) // a for l, a in config.items()))
            if m > 0 and sum(l * a for l, a in config.items()) >= FULL * capacity:
                plan.append((sorted((l for l, a in config.items() for _ in range(a)), reverse=True), m))
                for l, a in config.items():
                    left[l] -= a * m
    plan += best_fit(left, capacity)
    return plan


@dataclass
class Places:
    """Where ranks of a length go: sorted keys length * SPAN + first rank, and for each key a run of sequences."""

    key: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(plan: list[tuple[list[int], int]]) -> Places:
        rows, used, base = [], {}, 0
        for contents, m in plan:
            at = 0
            for l in sorted(set(contents), reverse=True):
                a = contents.count(l)
                rows.append((l * SPAN + used.get(l, 0), base, a, at))
                used[l] = used.get(l, 0) + a * m
                at += a * l
            base += m
        return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length * SPAN + rank, side="right") - 1
        within = length * SPAN + rank - self.key[k]
        return self.sequence[k] + within // self.each[k], self.offset[k] + within % self.each[k] * length


class Bases:
    """How many pieces of a length the tasks before a task have: files in the shared folder, PARTS tasks in each, from which a task reads
    the few rows that it needs. Over all tasks they grow with the documents, so they are not broadcast, and pieces need no join."""

    PARTS = 64

    def __init__(self, folder: str, capacity: int):
        self.folder, self.width, self.known = folder, capacity + 1, {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def write(self, base: DataFrame) -> None:
        """From rows (part, length, before)."""
        folder, width, parts = self.folder, self.width, self.PARTS

        def block(key: tuple, table: pa.Table) -> pa.Table:
            part, length, before = (table[c].to_numpy() for c in ("part", "length", "before"))
            rows = np.zeros((parts, width), "<i8")
            rows[part % parts, length] = before
            fs, root = open_store(folder)
            fs.create_dir(root, recursive=True)
            name = f"{root}/{key[0].as_py()}"
            with fs.open_output_stream(unfinished := f"{name}.{uuid.uuid4().hex}", compression=None) as f:
                f.write(rows.tobytes())
            fs.move(unfinished, name)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

        blocks = base.select(F.floor(F.col("part") / parts).cast("long").alias("block"), "part", "length", "before").groupBy("block").applyInArrow(block, "block long")
        blocks.count()  # a block has at most PARTS rows for each length

    def of(self, part: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part), np.int64)
        for p in np.unique(part).tolist():
            if p not in self.known:
                fs, root = open_store(self.folder)
                with fs.open_input_file(f"{root}/{p // self.PARTS}") as f:
                    f.seek(p % self.PARTS * self.width * 8)
                    if len(self.known) >= self.PARTS:
                        self.known.clear()
                    self.known[p] = np.frombuffer(f.read(self.width * 8), "<i8")
            own = part == p
            out[own] = self.known[p][length[own]]
        return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each row of a cut_pieces table its sequence_id and offset; its other columns stay, but for part and part_rank.

    No rows, no sequences. Ties (pieces of one length) go by part and part_rank, so a rerun gives the same places.
    """
    spark = pieces.sparkSession
    by_part = materialise(pieces.groupBy("part", "length").count(), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # capacity rows at most
        counts[row.length] = row.n
    places = spark.sparkContext.broadcast(Places.of(plan_sequences(counts, capacity)))
    # Rows of a window: the tasks that have a piece of that length.
    base = by_part.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    bases = Bases(scratch_dir(spark, "bases"), capacity)
    bases.write(base)

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(part: pa.Array, length: pa.Array, part_rank: pa.Array) -> pa.Array:
        part, length, rank = (x.to_numpy(zero_copy_only=False) for x in (part, length, part_rank))
        sequence, offset = places.value.find(length, rank + bases.of(part, length))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["sequence_id", "offset"])

    # Only these columns go to Python; ids, where there are any, stay in the JVM.
    placed = pieces.withColumn("place", place("part", "length", "part_rank"))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "part_rank")], "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of a packed table that has ids: sequence_id, ids, and the places where pieces start."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # a sequence holds capacity ids at most
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("starts"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most capacity ids; one row for each piece. See cut_pieces and pack."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return pack(cut_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity).select(*columns)


def op10_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
