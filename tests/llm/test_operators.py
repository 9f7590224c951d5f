"""Operators against brute force, round trips and held-out rows, and on odd rows: nulls, empty and very long texts, ties, repeats,
empty tables, columns with clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import components, decontamination, licenses, packing, pii, quality_classifier, quality_rules, shared, simhash, token_counts, token_records, warc
from tidemark.llm.tokens import encoder

from .rows import LONG, WORDS, documents, empty, odd

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark)


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def ids_of(text, tokenizer=Tokenizer.from_file(BPE)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# -- tokens


def test_chunks_give_the_ids_of_whole_texts():
    e, r = encoder(BPE), random.Random(1)
    letters = " \n\t\r\x1c\x0b　 \x85​\xa0ab1é.,'|-中"
    texts = ["", "don't  we'll", "x<|endoftext|> y", "a" * 300 + " " * 50 + "b", WORDS] + ["".join(r.choices(letters, k=r.randint(1, 40))) for _ in range(3000)]
    assert [t for t in texts if e.encode(t) != e.whole(t)] == []


def test_token_records_round_trip(spark, docs):
    folder = shared.scratch_dir(spark, "t")
    manifest = token_records.write_records(docs, folder, BPE, 2)
    got = token_records.read_records(manifest, folder).orderBy("start").collect()
    want = sorted(((i is not None, i or 0), ids_of(t) + [2]) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    assert [((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got] != [] and sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert token_records.read_records(token_records.write_records(empty(spark), shared.scratch_dir(spark, "t"), BPE, 2), folder).count() == 0


def test_damaged_records_are_noticed():
    data = bytearray(token_records.frame(5, np.array([1, 70_000], "<u4")))
    assert token_records.unframe(bytes(data), 0)[0] == 5 and token_records.unframe(bytes(data), 0)[1].tolist() == [1, 70_000]
    for k in range(len(data)):
        bad = data.copy()
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(bad), 0)


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, BPE, with_ids=True).collect()
    whole = sorted((tuple(ids_of(r.text) + [0])) for r in docs.collect())
    assert sum(r.length for r in rows) == sum(map(len, whole))
    sequences = {}
    for r in rows:
        assert 1 <= r.length <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        assert r.length == 2048 or r.piece == 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(map(len, whole)) // 2048)
    joined = packing.sequences(packing.pack_documents(docs, BPE, with_ids=True))
    assert joined.agg(F.max(F.size("ids"))).first()[0] <= 2048
    assert packing.pack_documents(empty(spark), BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_all_pieces(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    np.add.at(counts, np.clip(r.lognormal(5.5, 1.2, 20_000).astype(int), 1, 2048) if seed else r.choice([683, 341, 1025, 2048], 500), 1)
    plan, used = packing.plan_sequences(counts, 2048), np.zeros(2049, np.int64)
    for contents, m in plan:
        assert sum(contents) <= 2048 and m > 0
        np.add.at(used, contents, m)
    assert (used == counts).all()
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert sum(m for _, m in plan) <= least * (1.005 if seed else 1.2)
    places = packing.Places.of(plan)
    l = int(np.flatnonzero(counts)[0])
    s, o = places.find(np.full(counts[l], l), np.arange(counts[l]))
    assert len(set(zip(s.tolist(), o.tolist()))) == counts[l]


def best_count(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max(((best[b][0] + scores[word[b:end]], best[b][1] - 1) for b in range(max(0, end - 128), end) if word[b:end] in scores)))
    return -best[-1][1]


def pre_tokens(text):
    """By runs: the last space of a run goes to the word behind it."""
    out = []
    for run in re.findall("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text):
        if out and out[-1][-1:] == " " and not re.fullmatch("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", run):
            out[-1:] = [out[-1][:-1], " " + run] if len(out[-1]) > 1 else [" " + run]
        else:
            out.append(run)
    return out


def test_token_counts(spark, docs, some):
    m = token_counts.Unigrams(RANKS)
    words = sorted({w for r in some.limit(40).collect() for w in r.text.encode().split()})[:3000]
    got = m.terminals(b" " + w for w in words)
    assert [w for w in words if got[b" " + w] != best_count(b" " + w, m.scores)] == []
    more = documents(spark, [(20, "\n\n\n\n"), (21, "    a\n\n\tb"), (22, "a b"), (23, " x  y \n z "), (24, "\u3000\u2028q\x85 r\x1fs"), (25, "def f(x):\n        return x\n\n\n")])
    both = docs.unionByName(more).collect()
    rows = {(r.doc_id, r.n_pretokens): r.n_tokens for r in token_counts.count_tokens(docs.unionByName(more), RANKS).collect()}
    seen = {}
    n = lambda t: sum((seen.get(w) or seen.setdefault(w, best_count(w.encode(), m.scores))) * k for w, k in Counter(pre_tokens(t or "")).items())
    assert all(rows[r.doc_id, len(pre_tokens(r.text or ""))] == n(r.text) for r in both)
    assert all(x > 0 for (doc, _), x in rows.items() if doc in range(20, 26)) and rows[21, 4] > rows[22, 2]
    assert token_counts.count_tokens(empty(spark), RANKS).count() == 0


def test_token_counts_use_the_whole_vocabulary():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(sum(1 / (r + token_counts.OFFSET) for r in ranks.values()))
    cost = {p: math.log(r + token_counts.OFFSET) + norm for p, r in ranks.items()}

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(min((best[b][0] + cost[word[b:end]], best[b][1] + 1) for b in range(end) if word[b:end] in cost))
        return best[-1][1]

    words = [p for p in ranks if len(p) > 16] + [b" " + c * n for c in (b"-", b"=", b"_", b"*") for n in (31, 32, 63, 64, 65, 128, 200)]
    words += [b" " + w for w in b"responsibilities unconstitutional telecommunications disproportionately irresponsibilities telecommunicationsx".split()]
    got = token_counts.Unigrams(RANKS).terminals(words)
    assert [w for w in words if got[w] != count(w)] == [] and got[b" responsibilities"] == got[b" telecommunications"] == 1


def test_batches_of_long_texts_are_bounded(spark):
    texts = documents(spark, [(i, "x" * 300_000) for i in range(60)]).coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    seen = [r.n for r in shared.in_arrow(texts.select("text"), sizes, "n long").collect()]
    assert len(seen) > 3 and max(seen) <= shared.BATCH_BYTES + 400_000


# -- near duplicates


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(values, distance=3):
    roots = list(range(len(values)))
    def find(i):  # noqa: E306
        while roots[i] != i:
            i = roots[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                roots[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    roots = components_of(fps)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min((x for x in (least.get(root), r.doc_id) if x is not None), default=None)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(((r.doc_id is None, r.doc_id or 0), f, least[root]) for r, f, root in zip(rows, fps, roots))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots)) and 2 not in [r.doc_id for r in kept.collect()]


def test_links_of_fingerprints(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(25)} | {0})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v, v) for v in signed], "fp long, own long")
    for d in (0, 1, 2, 3):
        got = {frozenset((a, b)) for a, b in simhash.pigeonring_links(df, d).collect()}
        assert got == {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= d}


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (3, 4)] + [(2001, 2000)]
    got = {}
    for node, root in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(root, set()).add(node)
    assert sorted(map(sorted, got.values())) == [list(range(201)), list(range(1000, 1100)), [2000, 2001]]


# -- decontamination


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven wizards mix strange potions near the old stone bridge at midnight"), (2, None), (3, "two words"), (4, " ".join(f"unit{i} of long item" for i in range(60)))]


def test_contaminated(spark):
    item = ITEMS[0][1].split()
    edited = item[:6] + ["a"] + item[7:14] + ["very"] + item[14:]
    texts = [(1, WORDS + " " + ITEMS[0][1].upper() + " " + WORDS), (2, WORDS + " " + " ".join(edited)), (3, WORDS), (4, " ".join(item[:8]) + " " + WORDS), (5, None), (6, ""), (None, ITEMS[0][1]), (7, LONG + ITEMS[0][1]), (8, " ".join(f"unit{i} of long item" for i in range(20, 45))), (1, WORDS)]
    docs, items = documents(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (None, 1), (7, 1), (8, 4)} and found[1, 1] == 1.0 and found[2, 1] < 1
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6]
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 and decontamination.contaminated(empty(spark), items).count() == 0


def test_repeated_rows_and_items_that_share_an_id(spark):
    a, b = ITEMS[0][1], " ".join(f"other{k} word" for k in range(12))
    docs = documents(spark, [(1, WORDS + " " + a), (1, WORDS + " " + a), (2, b + " " + WORDS), (2, b), (3, WORDS), (None, b), (None, None), (4, a + " x " + b)])
    items = spark.createDataFrame([(1, a), (1, b), (2, a), (None, b), (5, ""), (6, None), (1, a)], "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs, items).collect()]
    assert sorted(found, key=repr) == sorted([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 1, 1.0), (2, None, 1.0), (2, None, 1.0), (None, 1, 1.0), (None, None, 1.0), (4, 1, 1.0), (4, 2, 1.0), (4, None, 1.0)], key=repr)
    assert sorted((r.doc_id for r in decontamination.decontaminate(docs, items).collect()), key=repr) == [3, None]
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_links_send_no_exploded_rows_through_the_driver(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) - (1 << 63) for _ in range(8000)]
    near = [x ^ 1 << 7 ^ 1 << 40 for x in fps[:50]]
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxBroadcastTableSize")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
        spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")  # what the planner takes for small fails where it is over three times so much
        found = simhash.links(spark.createDataFrame([(x,) for x in fps + near], "fp long"), 3).collect()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {frozenset(x) for x in found} == {frozenset(x) for x in zip(fps, near)}


def test_edited_copies_are_found_beside_exact_ones(spark):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(15, 59)))) for k in range(40)]
    texts = []
    for k, text in items:
        for step in (5, 6, 7, 8):
            words = text.split()
            for place in range(r.randrange(step), len(words), step):
                words[place] = r.choice(["new", f"{words[place]} added", words[(place + 1) % len(words)]])
            texts.append((100 * k + step, " ".join(r.choices(vocabulary, k=60) + words + r.choices(vocabulary, k=60))))
        if k % 2:
            texts.append((100 * k, text))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(documents(spark, texts), asked).collect()}
    words = {k: decontamination.words_of(t) for k, t in items}
    want = {(i, k) for i, t in texts for k, _ in items if decontamination.align(words[k], decontamination.words_of(t)) >= 0.6 * 2 * len(words[k])}
    assert len(want) > 150 and got == want


def test_recall_beside_common_copies(spark, monkeypatch):
    """Copies with words changed, added and left out, where exact copies make all n-grams common; the rarest of each block find them."""
    monkeypatch.setattr(decontamination, "RARE", 3)
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(2000)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(15, 59)))) for k in range(60)]
    texts = [(10_000 + 10 * k + c, f"{c} {t} {c}") for k, t in items for c in range(8)]
    for k, text in items:
        for case, share in enumerate((0.08, 0.12, 0.16)):
            out = []
            for w in text.split():
                x = r.random() / share
                out += [w] if x > 1 else [r.choice(vocabulary)] if x < 1 / 3 else [w, r.choice(vocabulary)] if x < 2 / 3 else []
            texts.append((10 * k + case, " ".join(r.choices(vocabulary, k=50) + out + r.choices(vocabulary, k=50))))
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = {k: decontamination.words_of(t) for k, t in items}
    want = {(i, k) for i, t in texts for k in [i // 10 if i < 10_000 else (i - 10_000) // 10] if decontamination.align(words[k], decontamination.words_of(t)) >= 0.6 * 2 * len(words[k])}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 600
    assert len([x for x in got if x[0] < 10_000]) >= 0.9 * len([x for x in want if x[0] < 10_000]) > 100


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Xyzzy"), (2, "plugh maze"), (3, "..."), (4, "one two three")], "item_id long, text string")
    docs = documents(spark, [(1, "say xyzzy now"), (2, "a plugh, maze"), (3, "plugh the maze"), (4, "maze plugh"), (5, "XYZZY plugh MAZE one two three")])
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()) == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 4)]
    with pytest.raises(ValueError):
        decontamination.contaminated(docs, items, 0.4)


def test_stretches_of_long_items_are_found_wherever_they_lie(spark):
    items = [(1, " ".join(f"a{k}" for k in range(128))), (2, " ".join(f"b{k}" for k in range(300)))]
    texts = [(1000 * i + k, f"before it {' '.join(t.split()[k : k + n])} after it") for i, t in items for n in (39, 70) for k in range(n % 2, len(t.split()) - n, 6)]
    found = decontamination.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i // 1000) for i, _ in texts}


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    r = random.Random(2)
    for _ in range(100):
        a, b = r.choices("abcd", k=r.randint(1, 15)), r.choices("abcde", k=r.randint(1, 30))
        assert decontamination.align(a, b) == slow_align(a, b)


# -- personal data: candidates beside base spans


def test_candidates_do_not_overlap_base_spans():
    r = random.Random(3)
    parts = ["1.1.1.1%", "2.2.2.2%", "5.5.5.5%", "555-123-4567", "@x.com", "a@b.co", " ", "+44 20 7946 0958", "x(at)y.org", "4111 1111 1111 1111", "12345678901234567890", "call "]
    texts = ["1.1.1.1%2.2.2.2%3.3.3.3%4.4.4.4%5.5.5.5%555-123-4567@x.com"] + ["".join(r.choices(parts, k=r.randint(2, 14))) for _ in range(4000)]
    met = 0
    for t in texts:
        kept, dropped = pii.base_spans(t)
        found = pii.candidates(t, kept, dropped)
        met += len(found)
        assert not [(x, y) for x in found for y in kept if y[1] < x[2] and y[2] > x[1]], t
    assert met > 1000


# -- licences


WRAPPED_MIT = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish."
WRAPPED_GPL = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n\nimport x"
#: Wordings that no training row has.
UNSEEN = [
    (WRAPPED_MIT, "mit"), (WRAPPED_GPL, "gpl"), ("The code is GPLv3, mind you.", "gpl"), ("covered by the GNU LGPL, version 2.1", "lgpl"), ("available under a Creative Commons Attribution licence", "cc-by"), ("distributed under the terms of the Apache License 2.0", "apache"),
    ("Distributed under the BSD 2-Clause license, as is.", "bsd"), ("This crate uses the MIT licence.", "mit"), ("Published under the terms of CC BY-SA 3.0 unported.", "cc-by-sa"), ("Our module ships under the Mozilla Public License 2.0, as do its tests.", "mpl"),
    ("This file is part of a program under the GNU Affero GPL v3.", "agpl"), ("Copyright 2020 Foo Inc. All rights reserved worldwide.", "proprietary"), ("Images: CC BY-NC 4.0, text separate.", "cc-by-nc"), ("We put this into the public domain.", "public-domain"), ("The ISC license applies to the daemon.", "isc"),
    ("You may use this under the terms of the Example License.", "unknown"), ("He lost his driving license and walked home.", None), ("Students at MIT met the Apache people.", None), ("prose of a day\nthe cat sat on the mat", None), ("A liquor license was granted to the bar.", None),
]


def test_licences(spark, some):
    assert not {t for t, _ in UNSEEN} & {t for _, t, _ in licenses.written()}
    model = licenses.LicenseModel(some)
    texts = [*enumerate(t for t, _ in UNSEEN), (100, None), (101, ""), (102, WORDS), (103, LONG), (104, "prose here\nReleased under the MIT License."), (105, "Copyright 2020 x. All rights reserved.\n\nThis work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."), (104, "prose here\nReleased under the MIT License.")]
    found = licenses.scan_licenses(documents(spark, texts), model).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.kind, r.place, r.family))
    right = [k for k, (_, family) in enumerate(UNSEEN) if {f for _, _, f in got.get(k, []) if f != "none"} == ({family} if family else set())]
    assert len(right) >= 0.9 * len(UNSEEN), sorted(set(range(len(UNSEEN))) - set(right))
    assert got[0] == [("block", 0, "mit")] and got[1] == [("block", 0, "gpl")]
    assert {k: sorted(v) for k, v in got.items() if k is None or k >= 100} == {104: [("line", 1, "mit")] * 2, 105: [("line", 0, "proprietary"), ("line", 2, "gpl")], None: [("line", 0, "mit")]}
    assert all(0 <= r.probability <= 1 and 0 <= r.similarity <= 1 for r in found)
    assert licenses.scan_licenses(empty(spark), model).count() == 0


#: Wordings that said nothing, or half, before: (text, families that are told).
WORDINGS = [
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", {"isc"}),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.", {"mit"}), ("Licensed under the EUPL-1.2", {"eupl"}), ("Eclipse Public License 2.0 applies.", {"epl"}),
    ("Dieses Werk steht unter einer Creative Commons Namensnennung 4.0 International Lizenz.", {"cc-by"}), ("This is under the WTFPL.", {"wtfpl"}), ("(c) 2021 ACME. Confidential and proprietary information.", {"proprietary"}),
    ("Everyone is permitted to copy and distribute verbatim copies of this license document.", {"gpl"}), ("Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software.", {"bsd"}),
    ("Choose the Apache License 2.0 or the MIT License.", {"apache", "mit"}), ("Dual licensed under GPLv2 and the MPL 2.0.", {"gpl", "mpl"}),
]


def test_touched_paragraphs_are_told(spark, some):
    model = licenses.LicenseModel(some)
    prose = ["The warranty of the car ended in May.", "She was granted permission to leave.", "A confidential talk.", "Copyright 1999", "Ohne Lizenz geht nichts."]
    texts = [*enumerate([t for t, _ in WORDINGS] + prose)]
    rows = licenses.scan_licenses(documents(spark, texts), model).collect()
    told = {k: [r for r in rows if r.doc_id == k] for k, _ in texts}
    assert [k for k, x in told.items() if not x] == []
    families = {k: {f for r in x for f in [r.family, *r.others] if f not in ("none", "unknown")} for k, x in told.items()}
    right = [k for k, (_, want) in enumerate(WORDINGS) if families[k] == want]
    assert len(right) >= 9, [(k, families[k], told[k]) for k in range(len(WORDINGS)) if k not in right]
    assert all(not families[k] for k in range(len(WORDINGS), len(texts)))
    assert all(r.others == [] for x in told.values() for r in x if r.family == "none")


def test_blocks_are_runs_of_short_lines(spark):
    r = random.Random(4)
    texts = {k: [r.choice(["", " ", "a b", " # c ", "x" * 100, "y" * 101, "é" * 99]) for _ in range(r.randint(1, 12))] for k in range(200)}
    rows = licenses.paragraphs(documents(spark, [(k, "\n".join(x)) for k, x in texts.items()])).collect()
    for doc, lines in texts.items():
        got = {(p.kind, p.place, p.paragraph) for p in rows if p.doc_id == doc}
        runs, want = [], {("line", k, x) for k, x in enumerate(lines)}
        for x in lines:
            if runs and x.strip() and len(x) <= 100 and runs[-1][-1].strip() and len(runs[-1][-1]) <= 100:
                runs[-1].append(x)
            else:
                runs.append([x])
        want |= {("block", k, licenses.JOIN.join(x)) for k, x in enumerate(runs) if len(x) > 1}
        assert got == want


def test_licences_without_prose(spark):
    model = licenses.LicenseModel(empty(spark))
    assert [r.family for r in licenses.scan_licenses(documents(spark, [(1, "Released under the MIT License.")]), model).collect()] == ["mit"]


# -- quality


def test_quality_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_rules_as_a_column_score_as_plain_rules(spark, docs):
    names = quality_classifier.STATISTICS
    rules = [(((0, "<=", 3.0), (4, ">", 0.001)), 1.5), (((10, ">", 0.5),), -0.7), (((8, "<=", 0.2), (8, ">", 0.1), (0, ">", 1.0)), 0.25)]
    for r in quality_classifier.measure(docs).withColumn("s", quality_classifier.RuleEnsemble(0.3, rules).score()).collect():
        odds = 0.3 + sum(w for rule, w in rules if all(r[names[k]] <= x if sign == "<=" else r[names[k]] > x for k, sign, x in rule))
        assert abs(r.s - 1 / (1 + math.exp(-odds))) < 1e-12


def test_training_takes_the_rows_of_least_hash(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), *[F.rand(k).alias(n) for k, n in enumerate(quality_classifier.STATISTICS)])
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    few = quality_classifier.train(rows, labels, 1000)
    least = rows.where(quality_classifier.in_training(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(1000)
    assert few == quality_classifier.train(least, labels, 1000)


def test_quality_classifier_odd_rows(spark, docs):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows in ([], [(3, 1), (7, 1)], [(1, None), (None, 1)], [(i, i % 2) for i in range(1, 11)]):
        got = quality_classifier.classify(docs, labels(rows)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    assert quality_classifier.classify(empty(spark), labels([])).count() == 0


def repeat_words(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(hit)


def test_quality_rules(spark, docs, some):
    extra = documents(spark, [(20, "a b c d e f g h " * 3), (21, "x\nx\n \ny\nx"), (22, "###$ a<b>c|d&e"), (23, " lead and trail ")])
    for r in quality_rules.measures(docs.unionByName(extra)).collect():
        t = r.doc.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeat_words(words))
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and (not r.kept or not r.base_failed)
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 3, None, 10}
    assert quality_rules.keep_documents(empty(spark)).count() == 0
    good = some.join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").select(*some.columns)
    judged = quality_rules.measures(good).where("NOT base_failed").select("kept").collect()
    assert np.mean([r.kept for r in judged]) > 0.97


# -- personal data


def brute_spans(t):
    out = []
    for kind, p in zip(pii.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((pii.KINDS.index(kind), *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choices("ab@.-_ +()0123456789123,é", k=r.randint(1, 60)))
        assert pii.base_spans(t)[0] == brute_spans(t), t
    long = "a" * 300_000 + "@b.c " + "1" * 300_000 + " " + "+1" + "(" * 300_000
    assert [k for k, _, _ in pii.base_spans(long)[0]] == [0]


CARD = "4111111111111111"


def test_pii(spark):
    texts = [(1, f"mail a.b@c.example.com or 10.0.0.1, card {CARD}, call +49 30 1234567"), (2, f"paid with card 12 {CARD} today"), (3, None), (4, ""), (5, "nothing 12 here"), (None, "x@y.de"), (1, "x@y.de"), (6, LONG + " x@y.de")]
    many = [(100 + i, f"write to user{i}@mail{i}.example.com or +1 (212) 555-0{i:03d} and 4{i:03d} then 192.0.2.{i % 250}") for i in range(60)]
    docs = documents(spark, texts + many)
    found = {(r.doc_id, len(r.spans)) for r in pii.find_pii(docs).collect()}
    assert {(1, 4), (2, 1), (3, 0), (4, 0), (5, 0), (None, 1), (1, 1), (6, 1)} <= found
    clean = pii.redact(docs)
    got = {(r.doc_id, (r.text or "")[-60:]) for r in clean.where("doc_id < 6").collect()}
    assert clean.columns == docs.columns and (2, "paid with card 12 [CARD] today") in got and clean.count() == docs.count()
    assert (1, "mail [EMAIL] or [IP], card [CARD], call [PHONE]") in got and clean.where("doc_id = 3 AND text IS NULL").count() == 1
    assert pii.find_pii(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_pii_query_digest(spark, tables):
    out = {r.doc_id: r for r in pii.op6_pii(spark, tables).collect()}
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        base = brute_spans(r.text or "")
        written = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert out[r.doc_id].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and set(written) <= {*out[r.doc_id].spans.split(",")} | {""}


# -- archives


def test_warc_round_trip(spark):
    big, same = "<p>" + "x" * 3000, "é" * 600
    pages = [(1, "http://a", big), (2, "http://b", big), (5, "http://c", big), (3, "http://d", same), (4, None, same), (6, "u", None), (7, "u v\n", "short"), (8, "u", "short"), (None, "n", big), (9, "z", "\x1f\x8b\x08" * 500)] + [(100 + i, "r", "".join(random.Random(i).choices("abcdefgh <>é", k=5000))) for i in range(60)]
    df = spark.createDataFrame([(*p, 1, "d", "m") for p in pages], "page_id long, url string, html string, size int, digest string, kept string")
    folder = shared.scratch_dir(spark, "w")
    files = warc.write_archives(df, folder, 2)
    want = {}
    for i, _, html in pages:
        body = (html or "").encode()
        rivals = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        ref = max(rivals) if len(body) >= 1000 and len([1 for _, _, h in pages if (h or "") == (html or "")]) > 1 and i != max(rivals) else None
        want[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if ref else "response", ref)
    for split in (100, 4096, 1 << 23):
        got = warc.read_archives(files, folder, split).collect()
        assert len(got) == len(pages) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
        assert all(bytes(r.payload).decode() == dict((i, h or "") for i, _, h in pages)[r.page_id] for r in got if r.record_type == "response")
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def test_labels_without_a_document_do_not_thin_out_the_rest(spark):
    """Many labels of absent documents, few training rows allowed: all that is allowed is still learnt from."""
    docs = documents(spark, [(i, ("good words in a sentence of prose. " if i % 2 else "buy buy buy 111 $$$ ") * (3 + i % 5)) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(10**6 + i, 0) for i in range(60_000)], "doc_id long, quality int")
    measured = quality_classifier.measure(docs)
    model = quality_classifier.train(measured, labels, 150)
    assert model.rules
    got = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, labels, 150).collect()}
    assert sum(got[i] == i % 2 for i in range(300)) > 290
