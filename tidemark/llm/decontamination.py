"""Benchmark decontamination: rare word n-grams of test items find passages, word alignment decides.

One pass over the texts takes the passages around n-grams of the items, and counts in how many passages each occurs. Seeds are all n-grams that are rare
in that count, and of each block of neighbouring ones the rarest that occurs: so a common n-gram does not tie all its passages to all
its items, and a copy whose n-grams are all common is found by one of each block that outlasts its edits. A join by seeds
names the windows of items that a passage may come from; it holds keys alone, and equal passages are one in it.
A bound on the score, from the words that both have, drops most chance meetings; a Smith-Waterman alignment over words
scores the rest: copies with words changed, added or left out align too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, materialise, text_or_empty

GRAM = 3
#: An n-gram is rare in up to this many passages, or this part of all.
RARE, RARE_PART = 64, 1e-4
#: Neighbouring n-grams of which the rarest is a seed in any case.
BLOCK = 4
#: Items are aligned in windows of at most this many words.
WINDOW = 64
#: A window starts each quarter of a window: what is enough of it for a copy is whole in one, wherever it lies.
STEPS = 4
#: Words of a passage before and after its seeds: what an alignment of half the greatest score can span at most.
AROUND = 2 * WINDOW
#: Words from a passage's first seed to its last at most.
SPAN = 512
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the greatest possible score from which on a passage counts as a copy.
COPY = 0.6
WORD = re.compile(r"[^\W_]+")
#: Up to this many n-grams go to the tasks as they are (8 MB); of more, only a table of bits does.
MOST_EXACT, TABLE_BITS, MOST_TABLE_BITS = 1 << 20, 22, 27
KEEP_WORDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = WordHashes()


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), "u8", len(words))


def gram_hashes(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A signed 64-bit hash for each n-gram of words with hashes h."""
    if len(h) < n:
        return np.empty(0, "i8")
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return out.view("i8")


class GramFilter:
    """Which hashes may be among some n-grams: exactly, or for very many of them by a table of fixed size. What the table lets through by chance
    makes passages more or longer, but no n-gram of an item: the join by seeds is exact, and an alignment without an n-gram in
    common scores 0.5 at most."""

    def __init__(self, grams: DataFrame):
        grams = grams.select("gram").distinct()
        n = grams.count()
        self.exact = None
        if n <= MOST_EXACT:
            self.bits = TABLE_BITS
            self.exact = np.sort(np.array([r.gram for r in grams.collect()], "i8"))
            places, bits = (self.exact & ((1 << self.bits) - 1)), None
            table = np.zeros(1 << self.bits, bool)
            table[places] = True
            self.packed = np.packbits(table)
        else:
            self.bits = min(MOST_TABLE_BITS, max(TABLE_BITS, (8 * n).bit_length()))
            place = F.col("gram").bitwiseAND(F.lit((1 << self.bits) - 1).cast("long"))
            rows = grams.select((place / 32).cast("long").alias("at"), F.shiftleft(F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("b"))
            packed = np.zeros(1 << (self.bits - 5), "<u4")
            for r in rows.toLocalIterator():  # 2^22 rows at most
                packed[r["at"]] = r["b"]
            self.packed = np.packbits(np.unpackbits(packed.view("u1"), bitorder="little"))
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.unpackbits(self.packed).view(bool)
        at = np.flatnonzero(self._table[hashes & ((1 << self.bits) - 1)])
        if self.exact is not None and len(at):
            h = hashes[at]
            k = np.minimum(np.searchsorted(self.exact, h), len(self.exact) - 1)
            at = at[self.exact[k] == h]
        return at


def item_windows(items: DataFrame) -> DataFrame:
    """Items (item_id, text) in overlapping windows of equal length: item_id, words (their hashes), n, grams of n words (fewer than
    GRAM for an item of fewer, which is one itself; none for one without words). A shared-folder table."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("n", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = word_hashes(words_of(text.as_py()))
                parts = max(1, -(-len(words) // WINDOW))
                size, steps = -(-len(words) // parts), STEPS * (parts - 1)
                starts = [(len(words) - size) * k // steps for k in range(steps)] + [len(words) - size]
                n = min(GRAM, size)
                out += [{"item_id": item_id, "words": words[x : x + size].tobytes(), "n": n, "grams": gram_hashes(words[x : x + size], n).tolist()} for x in starts if n]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    return materialise(in_arrow(rows, cut, "item_id long, words binary, n int, grams array<long>"), "items")


def passages(docs: DataFrame, sought: GramFilter, lengths: list[int]) -> DataFrame:
    """doc_id, text_key (a hash of the whole text), passage (its words' hashes) and the sought n-grams of these lengths in it. Each has AROUND
    words before and after its n-grams, so a copy is whole in the passage of any of its n-grams."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("passage", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in enumerate(b.column(2)):
                words = word_hashes(words_of(text.as_py()))
                hashes = [gram_hashes(words, n) for n in lengths]
                places = [sought.places(h) for h in hashes]
                at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
                if len(at):
                    for near in np.split(at, np.flatnonzero(np.diff(at) > AROUND) + 1):
                        for run in np.split(near, np.flatnonzero(np.diff((near - near[0]) // SPAN)) + 1):
                            grams = np.concatenate([h[p[(p >= run[0]) & (p <= run[-1])]] for h, p in zip(hashes, places)])
                            out.append({"doc_id": b.column(0)[i].as_py(), "text_key": b.column(1)[i].as_py(), "passage": words[max(0, run[0] - AROUND) : run[-1] + GRAM + AROUND].tobytes(), "grams": np.unique(grams).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    return in_arrow(rows, find, "doc_id long, text_key long, passage binary, grams array<long>")


def most_possible(item: np.ndarray, passage: np.ndarray, span: int) -> int:
    """A bound on the alignment score, from above: that of the best stretch of at most span words of the passage, if each
    of its words that the item has matched."""
    sums = np.concatenate([[0], np.cumsum(np.where(np.isin(passage, item), MATCH, -1))])
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(span, len(passage) * MATCH), sums]), span + 1)
    return int((sums - before.min(1)).max())


def align(item: list[str], passage: list[str]) -> int:
    """Greatest Smith-Waterman score of the two, by words."""
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.get(w, -1) for w in passage])
    slope = np.arange(len(b) + 1) * -GAP
    above, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        row = np.zeros(len(b) + 1, np.int64)
        np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope) - slope  # any run of gaps along the passage
        best = max(best, int(above.max()))
    return best


def chosen_seeds(windows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, gram) of windows (key, grams, in order) for passages (pid, grams): the rare n-grams and the rarest of each block, of those that occur."""
    times = found.select("pid", F.explode("grams").alias("gram")).distinct().groupBy("gram").agg(F.count("*").alias("times"))
    bound = max(RARE, found.count() * RARE_PART)
    grams = windows.select("key", F.posexplode("grams").alias("pos", "gram")).join(times, "gram")
    grams = grams.withColumn("block", F.floor(F.col("pos") / BLOCK))
    rarest = grams.groupBy("key", "block").agg(F.min(F.struct("times", "gram")).alias("b")).select("key", F.col("b.gram").alias("gram"))
    return rarest.unionByName(grams.where(F.col("times") <= bound).select("key", "gram")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, copy: float = COPY) -> DataFrame:
    """doc_id, text_key, item_id, score: the texts of docs (doc_id, text) that hold a copy of an item (item_id, text), and
    the best alignment's part of the greatest possible score, of the best window where an item is longer than one.

    copy, from 0.5 on, is the part that counts; an item of one or two words counts where it occurs as it is. Null and empty texts hold none; items without
    words, null ones too, are not sought. Rows that agree in doc_id and text are one, and of items that share an id the best score counts.
    Other columns are not read.
    """
    if not 0.5 < copy <= 1:
        raise ValueError("copy must lie above 0.5: below it alignments without an n-gram in common would count")
    windows = item_windows(items).withColumn("key", F.xxhash64("words"))
    of = windows.select("item_id", "key").distinct()
    each = windows.groupBy("key").agg(F.first("words").alias("words"), F.first("grams").alias("grams"), F.first("n").alias("n"))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect()) or [GRAM]  # GRAM at most
    # A table between the two Python steps: in one stage each task would hold two Python workers.
    found = materialise(passages(docs, GramFilter(windows.select(F.explode("grams").alias("gram"))), lengths).withColumn("pid", F.md5("passage")), "passages")
    seeds = chosen_seeds(each, found)
    met = found.select("pid", F.explode("grams").alias("gram")).join(seeds, "gram").select("pid", "key").distinct()
    texts = found.groupBy("pid").agg(F.first("passage").alias("passage"))
    pairs = met.join(texts, "pid").join(each.select("key", "words"), "key").select("pid", "key", "words", "passage")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for pid, key, words, passage in zip(*(c.to_pylist() for c in b.columns)):
                a, b_ = np.frombuffer(words, "u8"), np.frombuffer(passage, "u8")
                # A copy has MATCH * len(a) * (1 - copy) words more than the window at most: each costs 1.
                if most_possible(a, b_, len(a) + int(MATCH * len(a) * (1 - copy)) + 1) >= copy * MATCH * len(a):
                    s = align(a.tolist(), b_.tolist()) / (MATCH * len(a))
                    if s >= copy:
                        for column, value in zip(out, (pid, key, s)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.float64()))], names=["pid", "key", "score"])

    scored = in_arrow(pairs, score, "pid string, key long, score double")
    best = found.select("doc_id", "text_key", "pid").join(scored, "pid").join(of, "key")
    return best.groupBy("doc_id", "text_key", "item_id").agg(F.max("score").alias("score"))


def decontaminate(docs: DataFrame, items: DataFrame, copy: float = COPY) -> DataFrame:
    """The rows of docs that hold no copy of an item, with all their columns; equal rows fare alike. Null and empty texts stay, and without
    items all rows do."""
    found = materialise(contaminated(docs, items, copy).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == found["_key"]), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"))
