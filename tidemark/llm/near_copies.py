"""Near copies from a similarity on: SimHash and MinHash find candidates, the Jaccard similarity of whole shingle sets decides.

SimHash with pigeonring chains (simhash.links) finds what is nearly equal. It can't go down to a similarity of 0.8: such pairs differ in
about 10 of 64 bits and now and then in 20, and no chain of a ring is selective with such a budget. So signatures of
BANDS bands of ROWS minima stand beside the fingerprints: two texts of similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS; of pairs at 0.8 about 3 in a million share none, of more similar ones fewer. Texts with the same set
of shingles are one class.

Texts that share a band are not joined all to all. One of them, c, is held against the others: the one that shares most bands
with most texts, as the text does that the others are edits of. Of x and y that are both not similar to c, x has so few shingles
in common with c that what x and y must share is more than that, so they share one that c has not. Hence x goes on only
under the shingles that set it apart from c, and a text that is similar to c does so too; what is smaller than c and nearly all
within it goes on as one more group. Edits of c that have nothing else in common do not meet again. Those that meet are
held against the smallest of them, and what then is in different components is compared within the join, which gives links only.
Shingles are 32 bits wide there: two sets of 1000 share one by chance once in 4000 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import by_shuffle, in_arrow, materialise, scratch_tables, text_or_empty
from .simhash import keep_first, text_key

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Shingles whose hashes are multiplied at a time.
BLOCK = 1024
KEEP_WORDS = 60_000
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 1), "u8") * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The different hashes of the text's word n-grams, ascending: words as in simhash(), fewer than n are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), "u8", len(words))
    n = max(1, min(n, len(h)))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out) + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set of shingles; a set without any has keys of its own."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, "u8")
    for i in range(0, len(found), BLOCK):
        np.minimum(least, (FACTORS * found[i : i + BLOCK]).min(1), out=least)
    out = np.arange(BANDS, dtype="u8")
    for column in least.reshape(BANDS, ROWS).T:
        out = mixed(out) + column
    return mixed(out).view("i8")


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key (the text's hash), cls (its shingles' hash), size (how many), fp and bands of each row of docs
    (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("cls", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), n) for x in b.column(2)]
            cls = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], "u8").view("i8")
            keys = np.concatenate([bands(x) for x in sets]) if sets else np.empty(0, "i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype="i4") * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.int64()), lists], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs).alias("key"), text_or_empty("text").alias("text"))
    return in_arrow(rows, make, "doc_id long, key long, cls long, size long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """cls and shingles (the upper halves of their hashes, ascending as unsigned) of the texts whose hashes are asked (key)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [shingles(x.as_py(), n) for x in b.column(0)]
            cls = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in whole], "u8").view("i8")
            halves = [np.unique((x >> np.uint64(32)).astype("u4")).view("i4") for x in whole]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(halves, pa.list_(pa.int32()))], names=["cls", "shingles"])

    texts = docs.select(text_key(docs).alias("key"), text_or_empty("text").alias("text")).join(asked, "key", "left_semi")
    return in_arrow(texts.select("text"), make, "cls long, shingles array<int>").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with linked, whether their shingles have at least this Jaccard similarity; apart, the shingles of a that b has not; and
    within, whether a is smaller and has so much in common with b that apart may not tell of all that is similar to a."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked, apart, within = [], [], []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (z.values.to_numpy().view("u4") for z in (x, y))
                place = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                own = x[y[place] != x] if len(y) else x
                both = len(x) - len(own)
                linked.append(both >= similarity * (len(x) + len(y) - both))
                apart.append(own.view("i4"))
                within.append(not linked[-1] and len(x) < len(y) and both >= similarity * len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_()), pa.array(apart, pa.list_(pa.int32())), pa.array(within, pa.bool_())], names=["a", "b", "linked", "apart", "within"])

    side = lambda c: sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"{c}_shingles"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return in_arrow(joined.select("a", "b", "a_shingles", "b_shingles"), judge, "a long, b long, linked boolean, apart array<int>, within boolean")


def against_one(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """(a, b) for rows (cls and the columns key and order): each class against the first of a group with it, in this order."""
    place = F.struct(*order, "cls")
    first = rows.groupBy(*key).agg(F.min(place).alias("first"))
    return by_shuffle(rows).join(first, key).where("cls != first.cls").select(F.col("cls").alias("a"), F.col("first.cls").alias("b")).distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b), once each: classes (cls, size, bands) that share a band with others, against the central one of a band with them."""
    rows = classes.select("cls", "size", F.explode("bands").alias("band"))
    several = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(by_shuffle(rows).join(several, "band"), "bands")
    known = shared.groupBy("cls").agg((-F.sum("n")).alias("known"))  # less is more
    return against_one(by_shuffle(shared).join(known, "cls"), ["band"], "known", "size")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (cls) with own, the root of the class, or itself if it is in no component."""
    return rows.join(roots.select(F.col("node").alias("cls"), F.col("root").alias("found")), "cls", "left").withColumn("own", F.coalesce("found", "cls")).drop("found")


def edges(roots: DataFrame, *links: DataFrame) -> DataFrame:
    out = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for more in links:
        out = out.unionAll(more.select("a", "b"))
    return out


#: Texts of a group that one task compares with all of it.
BLOCK_TEXTS = 256
#: The group of what is nearly all within a text; other groups are those of a shingle.
WITHIN = 1 << 40


def components(docs: DataFrame, each: DataFrame, similarity: float, shingle: int, distance: int) -> DataFrame:
    """(node, root) of the classes of a signatures() table of docs that similarity links."""
    classes = materialise(each.groupBy("cls").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    # SimHash: classes of one fingerprint against the least of them, and those of linked fingerprints against each other.
    fps = materialise(classes.groupBy("fp").agg(F.min("cls").alias("least")), "fingerprints")
    first = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_least"))
    near = simhash.links(fps.select("fp"), distance).join(first("a"), "a").join(first("b"), "b").select("a_least", "b_least")
    near = near.unionAll(classes.join(fps, "fp").select("cls", "least")).toDF("a", "b").where("a != b").distinct()
    found = candidates(classes).withColumn("central", F.lit(True)).unionAll(near.withColumn("central", F.lit(False)))
    begun = materialise(found.groupBy("a", "b").agg(F.max("central").alias("central")), "pairs")
    asked = materialise(begun.select("a").unionAll(begun.select("b")).distinct().withColumnRenamed("a", "cls"), "asked")
    sets = materialise(shingle_sets(docs, classes.join(asked, "cls", "left_semi").select("key"), shingle), "shingles")
    judged = materialise(compared(begun, sets, similarity).join(begun, ["a", "b"]), "judged")
    roots = connected_components(judged.where("linked"))
    # Groups of a central text with two more or above, of which some aren't similar to it: those go on under what sets them apart.
    open_ = judged.where("central").groupBy("b").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("others")).where("n > 1 AND others > 0").select("b")
    left = judged.where("central").join(open_, "b", "left_semi").select("b", F.col("a").alias("cls"), "apart", "within")
    left = rooted(left.join(classes.select("cls", "size"), "cls"), roots)
    group = F.concat(F.col("apart").cast("array<long>"), F.when(F.col("within"), F.array(F.lit(WITHIN).cast("long"))).otherwise(F.array().cast("array<long>")))
    grouped = left.select("b", "cls", "size", "own", F.explode(group).alias("group"))
    several = grouped.groupBy("b", "group").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x != y").select("b", "group")
    grouped = materialise(by_shuffle(grouped).join(several, ["b", "group"]).select("b", "group", "cls", "size"), "apart")
    tried = judged.select("a", "b").unionAll(judged.select(F.col("b").alias("a"), F.col("a").alias("b")))
    again = materialise(against_one(grouped, ["b", "group"], "size").join(tried, ["a", "b"], "left_anti"), "pairs")
    more = materialise(compared(again, sets, similarity).where("linked").select("a", "b"), "judged")
    roots = connected_components(edges(roots, more))
    own = rooted(grouped, roots)
    several = own.groupBy("b", "group").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x != y").select("b", "group")
    rest = by_shuffle(own).join(several, ["b", "group"], "left_semi").select("b", "cls", "own").distinct()
    parts = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
    own = materialise(rest.join(rest.groupBy("b").agg(F.count("*").alias("n")), "b").withColumn("parts", parts).join(sets, "cls"), "apart")
    # A large group is dealt out: each part of it meets the whole group in a task of its own.
    x = own.select("b", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), *[F.col(k).alias(f"x_{k}") for k in ("cls", "own", "shingles")])
    y = own.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(k).alias(f"y_{k}") for k in ("cls", "own", "shingles")])
    n, m = F.size("x_shingles"), F.size("y_shingles")
    # Sets whose sizes differ more cannot be similar enough.
    near = (F.col("x_cls") > F.col("y_cls")) & (F.col("x_own") != F.col("y_own")) & (n >= similarity * m) & (m >= similarity * n)
    alike = F.size(F.array_intersect("x_shingles", "y_shingles")) * (1 + similarity) + 1e-9 >= similarity * (n + m)
    last = by_shuffle(x).join(y, ["b", "part"]).where(near & alike).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct()
    return connected_components(edges(roots, last))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, distance: int = 3) -> DataFrame:
    """docs without near copies: of the rows that links of at least this similarity connect one stays, that of the least
    doc_id, with all its columns, chosen as simhash.keep_one does. Null and empty texts are copies of each other."""
    with scratch_tables(docs.sparkSession) as keep:
        each = materialise(signatures(docs, shingle), "signatures")
        joined = components(docs, each, similarity, shingle, distance)
        rows = each.join(joined, each["cls"] == joined["node"], "left").select(F.coalesce("root", "cls").alias("root"), "doc_id", "key")
        return keep_first(docs, rows, keep)
