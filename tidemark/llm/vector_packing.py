"""Packing of instruction data under several limits at once: tokens, segments and loss-bearing tokens of a sequence.

An example is a vector of the three: its ids, one segment, and the ids that bear loss (a prompt's do not). The driver plans on a histogram of these
vectors; its bins are lengths up to the capacity times LEVELS shares of loss, rounded up, whatever the number of examples. A sequence is filled by the
dot-product heuristic: of the vectors that fit, that comes next whose product with what is left of the limits, weighted by the whole demand
for each, is greatest. When none fits whole, one is cut. The sequence's contents are repeated as often as the counts allow, so
each plan entry uses a vector up, and the plan has no more entries than there are vectors and cuts. What is left at the end is cut at powers of two.

The examples stay distributed. Each has a rank among those of its vector, and runs of ranks have places; the rest of a cut example gets
a rank of its own vector, and is looked up in turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packing import Bases
from .shared import in_arrow, materialise, scratch_dir, text_or_empty
from .tokens import encoder

#: Shares of loss that are told apart.
LEVELS = 17
#: Ranks of a vector, and the first number of what stands for the rest of an example within a sequence that is cut at powers of two.
SPAN, INNER = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Limits:
    """Of a sequence. No example can bear more loss than it has tokens, so a loss limit of tokens is none."""

    tokens: int = 2048
    segments: int = 32
    loss: int = 1792


def cut_examples(rows: DataFrame, tokenizer: str, limits: Limits, end_id: int, prompt: str | None = None, prefix: float = 0.25) -> DataFrame:
    """A shared-folder table of pieces of at most the lesser of limits.tokens and limits.loss ids, for rows (doc_id, text and the prompt column).

    An example's ids are the prompt's (if a column is named), the text's and end_id. Without loss are the prompt's, or, where no column is named,
    the prefix share of all (rounded down). Null texts and prompts count as empty. bare: ids at the piece's start that bear no loss;
    code: its vector; part and part_rank: the task that made it, and its number among the task's pieces of that vector.
    """
    names = ["doc_id", "start", "length", "bare", "doc_tokens", "code", "part", "part_rank", "ids"]
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])
    longest = min(limits.tokens, limits.loss)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                first = enc.encode(asked) if asked else b""
                ids = np.frombuffer(first + enc.encode(text.as_py()) + end, "<u4")
                n = len(ids)
                bare = len(first) // 4 if prompt else int(n * prefix)
                kept = ids.astype("<u2") if narrow else ids
                for a in range(0, n, longest):
                    length = min(longest, n - a)
                    free = min(max(bare - a, 0), length)
                    code = length * LEVELS + -(-(length - free) * (LEVELS - 1) // length)
                    rank = seen.get(code, 0)
                    seen[code] = rank + 1
                    for column, value in zip(out, (doc_id, a, length, free, n, code, part, rank, kept[a : a + length].tobytes())):
                        column.append(value)
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (text_or_empty(prompt) if prompt else F.lit("")).alias("prompt"))
    return materialise(in_arrow(texts, cut, "doc_id long, start long, length long, bare long, doc_tokens long, code long, part long, part_rank long, ids binary"), "examples")


class Plan:
    """Places for counts of vectors, as runs of ranks. codes: sorted, of the vectors that the counts are of; a vector's number is its place there."""

    def __init__(self, codes: list[int], counts: list[int], limits: Limits):
        self.codes, self.limits = codes, limits
        self._number = {c: k for k, c in enumerate(codes)}
        self.length = np.array([c // LEVELS for c in codes], np.int64)
        self.loss = -(-self.length * np.array([c % LEVELS for c in codes], np.int64) // (LEVELS - 1))
        self.left = np.array(counts, np.int64)
        self._ranks, self._used = list(counts), [0] * len(codes)
        self.sequences = self._inner = 0
        self._runs: list[tuple] = []
        demand = np.array([self.left @ self.length / limits.tokens, self.left.sum() / limits.segments, self.left @ self.loss / limits.loss])
        self._weights = demand / max(demand.sum(), 1e-9)
        while self.left.any():
            self._fill()
        runs = np.array(sorted(self._runs), np.int64).reshape(-1, 8)
        self._key, self._base, self._stride, self._offset, self._take, self._next, self._next_rank, _ = runs.T

    def _vector(self, length: int, loss: int) -> int:
        """The number of the vector of the rest of a cut example."""
        code = length * LEVELS + -(-loss * (LEVELS - 1) // length)
        if code not in self._number:
            self._number[code] = len(self._ranks)
            self._ranks.append(0)
            self._used.append(0)
            self.length, self.left = np.append(self.length, length), np.append(self.left, 0)
            self.loss = np.append(self.loss, -(-length * (code % LEVELS) // (LEVELS - 1)))
        return self._number[code]

    def _choose(self, left: np.ndarray, tokens: int, segments: int, loss: int) -> tuple[int, int] | None:
        """The vector that comes next, and how many ids of it; None if nothing does."""
        fits = np.flatnonzero((left > 0) & (self.length <= tokens) & (self.loss <= loss))
        if len(fits):
            exact = fits[self.length[fits] == tokens]
            fits = exact if len(exact) else fits  # one that ends the sequence leaves nothing to cut
            t, s, q = self._weights * (tokens, segments, loss) / (self.limits.tokens, self.limits.segments, self.limits.loss)
            product = t * self.length[fits] / self.limits.tokens + s / self.limits.segments + q * self.loss[fits] / self.limits.loss
            k = int(fits[product.argmax()])
            return k, int(self.length[k])
        some = np.flatnonzero(left > 0)
        take = np.minimum(tokens, loss + self.length[some] - self.loss[some])
        if not len(some) or take.max() < 1:
            return None
        k = int(np.lexsort((-self.length[some], -take))[0])
        return int(some[k]), int(take[k])

    def _fill(self) -> None:
        """One sequence's contents, repeated while there are such vectors."""
        tokens, segments, loss = self.limits.tokens, self.limits.segments, self.limits.loss
        contents: list[tuple[int, int, int]] = []  # vector, place in the sequence, ids
        left = self.left.copy()
        while tokens and segments and (found := self._choose(left, tokens, segments, loss)):
            k, take = found
            contents.append((k, self.limits.tokens - tokens, take))
            left[k] -= 1
            tokens, segments = tokens - take, segments - 1
            loss -= int(max(0, take - (self.length[k] - self.loss[k])))
        used = self.left - left
        times = int((self.left[used > 0] // used[used > 0]).min())
        filled = self.limits.tokens - tokens
        edges = [0, filled] if not tokens else [0, *np.cumsum([1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]).tolist()]
        self.left -= used * times
        for k, at, take in contents:
            self._place(k, at, take, times, edges)
        self.sequences += times * (len(edges) - 1)

    def _place(self, k: int, at: int, take: int, times: int, edges: list[int]) -> None:
        key = k * SPAN + self._used[k]
        self._used[k] += times
        stop, stride = at + take, len(edges) - 1
        while at < stop:
            j = int(np.searchsorted(edges, at, side="right")) - 1
            part = min(stop, edges[j + 1]) - at
            after = rank = -1
            if at + part < stop:
                after, rank = INNER + self._inner, 0
                self._inner += 1
            elif take < self.length[k]:
                rest = int(self.length[k]) - take
                after = self._vector(rest, min(rest, int(self.loss[k])))
                rank = self._ranks[after]
                self._ranks[after] += times
                self.left[after] += times
            self._runs.append((key, self.sequences + j, stride, at - edges[j], part, after, rank, times))
            key, at = after * SPAN + rank, at + part

    def find(self, code: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, where its ids begin, how many, sequence, offset) for each piece of rows of these vectors and ranks, in steps."""
        row, vector, start = np.arange(len(code)), np.searchsorted(self.codes, code), np.zeros(len(code), np.int64)
        while len(row):
            k = np.searchsorted(self._key, vector * SPAN + rank, side="right") - 1
            i = vector * SPAN + rank - self._key[k]
            yield row, start, self._take[k], self._base[k] + i * self._stride[k], self._offset[k]
            on = self._next[k] >= 0
            row, start, vector, rank = row[on], (start + self._take[k])[on], self._next[k][on], (self._next_rank[k] + i)[on]


def pack(pieces: DataFrame, limits: Limits, with_ids: bool = False) -> DataFrame:
    """Rows of a cut_examples table in their sequences: doc_id, start, length, ids_crc32, doc_tokens, bare, sequence_id, offset, and
    ids where asked for. No rows, no sequences. Pieces of one vector go by part and part_rank, so a rerun gives the same places."""
    spark = pieces.sparkSession
    by_part = materialise(pieces.groupBy("part", "code").count(), "vectors")
    counts = sorted(tuple(r) for r in by_part.groupBy("code").agg(F.sum("count")).collect())  # limits.tokens * LEVELS rows at most
    plan = spark.sparkContext.broadcast(Plan([c for c, _ in counts], [n for _, n in counts], limits))

    @F.arrow_udf("long")
    def number(code: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(plan.value.codes, code.to_numpy()), pa.int64())

    # Rows of a window: the tasks that have a piece of that vector.
    before = F.coalesce(F.sum("count").over(W.partitionBy("code").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = Bases(scratch_dir(spark, "bases"), len(counts))
    bases.write(by_part.select("part", number("code").alias("length"), before.alias("before")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, start, length, bare, doc_tokens, code, part, rank = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:8])
            ids = [np.frombuffer(b.as_buffer(), f"<u{len(b.as_buffer()) // n}") for b, n in zip(batch.column(8), length.tolist())]
            rank = rank + bases.of(part, np.searchsorted(plan.value.codes, code))
            for row, begin, n, sequence, offset in plan.value.find(code, rank):
                own = [ids[r][a : a + k].astype("<u4") for r, a, k in zip(row.tolist(), begin.tolist(), n.tolist())]
                crc = [zlib.crc32(x) for x in own]
                columns = [batch.column(0).take(pa.array(row)), start[row] + begin, n, crc, doc_tokens[row], np.clip(bare[row] - begin, 0, n), sequence, offset]
                lists = [pa.array([x.astype("i4") for x in own], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + lists, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bare", "sequence_id", "offset"] + ["ids"] * with_ids
    rows = pieces.select("doc_id", "start", "length", "bare", "doc_tokens", "code", "part", "part_rank", "ids")
    return in_arrow(rows, place, ", ".join(f"{n} long" for n in names[:8]) + ", ids array<int>" * with_ids)


def pack_examples(rows: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, prompt: str | None = None, prefix: float = 0.25, with_ids: bool = False) -> DataFrame:
    """Pack rows (doc_id, text) into sequences within all limits; one row for each piece. See cut_examples and pack.

    Sequences have limits.tokens ids, but for the last of the plan, whose lengths are powers of two: none needs padding. An example is cut where it
    is longer than a piece may be, where no whole one fills a sequence, and in the last ones. Other columns are not read.
    """
    return pack(cut_examples(rows, tokenizer, limits, end_id, prompt, prefix), limits, with_ids)


def op11_vector_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 2048 ids, 32 pieces and 1792 ids that bear loss; a document's first quarter is its prompt."""
    import public_tokenizers

    return pack_examples(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
