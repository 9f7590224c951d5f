"""Vector packing: every id in one place, all limits held, no padding, plans of any vectors, odd rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import vector_packing as vp

from .rows import documents, empty, odd

BPE = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text, tokenizer=Tokenizer.from_file(BPE)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check(rows, examples, limits):
    """examples: (doc_id, ids, ids without loss), repeats included; rows have ids."""
    by_doc, sequences = {}, {}
    for r in rows:
        assert r.length >= 1 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc_id, ids, bare in examples:
        want.setdefault(doc_id, []).append((ids, bare))
    assert by_doc.keys() == want.keys()
    for doc_id, pieces in by_doc.items():
        placed = sum((Counter((r.doc_tokens, r.start + k, t, k >= r.bare) for k, t in enumerate(r.ids)) for r in pieces), Counter())
        assert placed == sum((Counter((len(ids), k, t, k >= bare) for k, t in enumerate(ids)) for ids, bare in want[doc_id]), Counter())
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r.length - r.bare for r in own) <= limits.loss
        lengths.append(at)
    assert all(n == limits.tokens or n & (n - 1) == 0 for n in lengths)
    return lengths


def test_documents(spark):
    docs = odd(spark)
    limits = vp.Limits()
    rows = vp.pack_examples(docs, BPE, with_ids=True).collect()
    examples = [(r.doc_id, ids_of(r.text) + [1], (len(ids_of(r.text)) + 1) // 4) for r in docs.collect()]
    lengths = check(rows, examples, limits)
    assert sum(n < 2048 for n in lengths) <= 11
    assert vp.pack_examples(empty(spark), BPE).count() == 0


def test_instruction_rows(spark):
    """Prompts bear no loss; small limits of segments and loss bind."""
    texts = [(i % 290 or None, None if i == 5 else f"question {i} " * (i % 31), None if i == 9 else "answer it so " * (i % 40)) for i in range(300)] + [(500, "q " * 900, ""), (501, "", "a " * 900)]
    df = spark.createDataFrame([(i, q, a, 1, 2, 3) for i, q, a in texts], "doc_id long, asked string, text string, code int, part int, bare int")
    limits = vp.Limits(256, 6, 160)
    rows = vp.pack_examples(df, BPE, limits, end_id=7, prompt="asked", with_ids=True).collect()
    lengths = check(rows, [(i, ids_of(q) + ids_of(a) + [7], len(ids_of(q))) for i, q, a in texts], limits)
    assert sum(n for n in lengths if n == 256) > 0.7 * sum(lengths)


@pytest.mark.parametrize("seed, limits", [(0, vp.Limits()), (1, vp.Limits(2048, 5, 2048)), (2, vp.Limits(2048, 64, 1100)), (3, vp.Limits(64, 3, 7)), (4, vp.Limits(1, 1, 1))])
def test_plans_of_any_vectors(seed, limits):
    r = np.random.default_rng(seed)
    longest = min(limits.tokens, limits.loss)
    length = np.clip(r.lognormal(4.5, 1.3, 5000).astype(int), 1, longest)
    bare = (length * r.choice([0, 0.2, 0.6, 1], 5000)).astype(int)
    code = length * vp.LEVELS + -(-(length - bare) * (vp.LEVELS - 1) // length)
    n = Counter(code.tolist())
    plan = vp.Plan(sorted(n), [n[c] for c in sorted(n)], limits)
    seen: Counter = Counter()
    rank = np.array([(seen.update([c]) or seen[c] - 1) for c in code.tolist()])
    got = [np.stack(x) for x in plan.find(code, rank)]
    row, start, take, sequence, offset = np.concatenate(got, axis=1)
    order = np.lexsort((start, row))
    ends = Counter()
    for k in order:  # pieces of a row follow each other
        assert start[k] == ends[row[k]]
        ends[row[k]] += take[k]
    assert all(ends[k] == length[k] for k in range(5000))
    tokens, loss = Counter(), Counter()
    pieces = Counter(sequence.tolist())
    for k in range(len(row)):
        tokens[sequence[k]] += take[k]
        loss[sequence[k]] += take[k] - np.clip(bare[row[k]] - start[k], 0, take[k])
    at = Counter()
    for k in np.lexsort((offset, sequence)):
        assert offset[k] == at[sequence[k]]
        at[sequence[k]] += take[k]
    assert set(tokens) == set(range(plan.sequences))
    assert max(tokens.values()) <= limits.tokens and max(loss.values()) <= limits.loss and max(pieces.values()) <= limits.segments
    assert all(t == limits.tokens or t & (t - 1) == 0 for t in tokens.values())


def test_query_has_every_document(spark, tables):
    rows = vp.op11_vector_packing(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = {r.doc_id: ids_of(r.text) + [1] for r in docs.select("doc_id", "text").collect()}
    at = Counter()
    for r in rows.orderBy("doc_id", "start").collect():
        ids = want[r.doc_id]
        assert (r.start, r.doc_tokens) == (at[r.doc_id], len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in want.items()}
    lengths = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count()
    assert lengths <= 11
