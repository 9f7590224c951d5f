"""Near-duplicate groups by SimHash fingerprints; candidates by pigeonring filtering.

A fingerprint is a ring of SEGMENTS equal parts. If two differ in at most d bits, then from some part on, going round
the ring, every chain of 1, 2, .. parts differs in at most its proportional share of d: for four parts and d = 3, in 0,
1, 2 and 3 bits. So the first part must be equal and the second differ in one bit at most. Both go into the join's
key: one side has a key for each start, the other one for each start and each way to change one bit or none. The
longer chains are checked on the joined rows, and only then all bits.

What the join costs follows the number of different fingerprints, as copies are put together before it. A dense clump of
near copies would still join all to all; so those that share three parts are first linked to the least of
them (at most 2^16 differ in one part), and the join asks only for links between different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import by_shuffle, in_arrow, materialise, parallelism, scratch_tables, text_or_empty

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
SEED = 42
#: Shingles hashed at a time; a text may have any number.
BLOCK = 1 << 16


def simhash(text: str, shingle: int = 3) -> int:
    """Fingerprint of text as an unsigned integer: ASCII letters lower-cased, words cut at ASCII white space, a bit
    set if over half the hashes of the word shingles have it. Fewer words than a shingle are one; no words give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        part = words[i : i + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_key(docs: DataFrame):
    """A hash of the whole text; with doc_id it names a row, or rows equal in both."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (the text's hash) and fp, the fingerprint's 64 bits as a signed long, for each row of docs (doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(x.as_py(), shingle) for x in b.column(2)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs).alias("key"), text_or_empty("text").alias("text"))
    return in_arrow(rows, make, "doc_id long, key long, fp long")


def segment(fp, i: int):
    """Part i of the ring as a long."""
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def differing(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def clump_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links from fingerprints to the least of those that agree in all parts but one, where near enough."""
    masks = [~(((1 << WIDTH) - 1) << (WIDTH * i)) & (1 << BITS) - 1 for i in range(SEGMENTS)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("rest")) for i, m in enumerate(signed)])).alias("k")).select("fp", "k.*")
    least = keyed.groupBy("part", "rest").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return by_shuffle(keyed).join(least, ["part", "rest"]).where((F.col("fp") != F.col("least")) & (differing(F.col("fp"), F.col("least")) <= distance)).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def pigeonring_links(fps: DataFrame, distance: int) -> DataFrame:
    """All pairs of fingerprints (fp, own) with different own at most distance (0 to 3) bits apart: (a, b), both ways round maybe."""
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"distance must be from 0 to {SEGMENTS - 1}")
    # A small table would be read by a few tasks, each of which would make all the keys of its rows.
    fps = fps.repartition(parallelism(fps.sparkSession), "fp")
    start = lambda i: F.lit(i << 2 * WIDTH).cast("long")
    key = lambda i, change: (F.shiftleft(segment(F.col("fp"), i), WIDTH) + segment(F.col("fp"), i + 1).bitwiseXOR(F.lit(change).cast("long")) + start(i))
    changes = [0, *(1 << k for k in range(WIDTH))] if distance >= 2 else [0]
    index = fps.select(F.col("fp").alias("a"), F.col("own").alias("a_own"), F.explode(F.array(*[key(i, 0) for i in range(SEGMENTS)])).alias("key"))
    probe = fps.select(F.col("fp").alias("b"), F.col("own").alias("b_own"), F.explode(F.array(*[key(i, c) for i in range(SEGMENTS) for c in changes])).alias("asked"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    at = F.shiftrightunsigned(F.col("key"), 2 * WIDTH)
    # The ring turned so that the chain's first part is lowest.
    ring = F.when(at == 0, x)
    for i in range(1, SEGMENTS):
        ring = ring.when(at == i, F.shiftrightunsigned(x, WIDTH * i).bitwiseOR(F.shiftleft(x, BITS - WIDTH * i)))
    chain = lambda n: F.bit_count(ring.bitwiseAND(F.lit((1 << WIDTH * n) - 1).cast("long"))) * SEGMENTS <= n * distance
    near = (F.col("key") == F.col("asked")) & (F.col("a_own") != F.col("b_own")) & chain(3) & (F.bit_count(x) <= distance)
    return by_shuffle(index).join(probe, near).select("a", "b")


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints (column fp, each once) at most distance bits apart."""
    clumps = connected_components(clump_links(fps, distance))
    own = fps.join(clumps, fps["fp"] == clumps["node"], "left").select("fp", F.coalesce("root", "fp").alias("own"))
    return pigeonring_links(own, distance).unionAll(clumps.select(F.col("node").alias("a"), F.col("root").alias("b")))


def grouped(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, key, fp, root of its component and copies (rows of its fingerprint) of each row of docs (doc_id, text)."""
    each = materialise(fingerprints(docs, shingle), "fingerprints")
    fps = materialise(each.groupBy("fp").agg(F.count("*").alias("copies")), "classes")
    joined = connected_components(links(fps.select("fp"), distance))
    roots = fps.join(joined, fps["fp"] == joined["node"], "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"))
    return each.join(roots, "fp", "left").select("doc_id", "key", "fp", "root", "copies")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp, component_id, links.

    component_id is the least doc_id of the rows reachable through fingerprints at most distance bits apart (null
    only if none of them has a doc_id); links counts the other rows with the same fingerprint. Null and
    empty texts have fingerprint 0 and link like others. Other columns are not read.
    """
    with scratch_tables(docs.sparkSession) as keep:
        rows = keep(materialise(grouped(docs, distance, shingle), "grouped"))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return by_shuffle(rows).join(least, "root").select("doc_id", "fp", "component_id", (F.col("copies") - 1).alias("links"))


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """docs without near duplicates: of each component one row stays, that of the least doc_id, with all its columns.

    Rows without a doc_id come after all others. Of rows that share that doc_id the one of least text hash stays, of
    rows that are equal in both any one.
    """
    with scratch_tables(docs.sparkSession) as keep:
        return keep_first(docs, grouped(docs, distance, shingle).select("root", "doc_id", "key"), keep)


def keep_first(docs: DataFrame, rows: DataFrame, keep) -> DataFrame:
    """The rows of docs that keep_one leaves, if rows (root, doc_id, key) name the component of each. Columns of docs may have
    any names. keep saves the last table from the end of the scratch tables."""
    rows = rows.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    rows = materialise(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")), "grouped")
    first = rows.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    judged = by_shuffle(rows).join(first.where("rows > 1"), "root").where("place != first")
    some_twice = not rows.where("n > 1").isEmpty()
    gone = keep(materialise(judged.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")), "near-duplicates"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("row_id"), text_key(docs).alias("row_key"))
    left = own.join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")), "left_anti")
    if some_twice:
        # Some rows share doc_id and text: only those meet in one place.
        left = left.dropDuplicates(["row_id", "row_key"])
    return left.select("doc.*")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")
