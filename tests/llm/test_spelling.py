"""Spelling variants against brute force: the whole query, cut keys, the automata, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling

from .rows import documents, empty, odd


def words_of(rows):
    """The contract's words, by itself."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(n):
    at = {}
    for w in n:
        at.setdefault(len(w), []).append(w)
    partners = {w: [x for l in (-1, 0, 1) for x in at.get(len(w) + l, []) if near(w, x)] for w in n}
    form = {}
    for w, ps in partners.items():
        best = min(ps, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w, ps in partners.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(ps), n[form[w]] if form[w] else None))
    return out


def table(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_all_pairs(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    n = words_of((r.doc_id, r.text) for r in docs)
    got = table(spelling.op13_spelling_variants(spark, tables))
    assert got == brute(n) and sum(r[4] for r in got) > 100 and any(r[1] for r in got)


@pytest.mark.parametrize("most, chunk", [(20_000, 20_000), (3, 1), (1, 4)])
def test_keys_that_are_cut_lose_no_pair(spark, most, chunk):
    """A few letters, repeats of a letter, so that errors have several alignments and keys many words; words from two code points on."""
    r = random.Random(most)
    n = {"".join(r.choices("abé", k=r.randint(2, 9))): r.choice([1, 2, 30, 500]) for _ in range(500)} | {"aaaaaaa": 7, "aaaaaaaa": 100, "aaaaaaaaa": 9, "aaaaaaé": 100}
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, key string")
    assert table(spelling.group_variants(df, most=most, chunk=chunk)) == brute(n)


def test_automaton_numbers_words():
    words = sorted({"".join(random.Random(i).choices("abc", k=1 + i % 7)) for i in range(400)})
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words)))
    assert len(spelling.Automaton(["abcxyz", "abdxyz"]).arcs) < 8  # ends are shared
    assert spelling.Automaton([]).arcs == [{}]


def test_forms_lead_to_roots(spark):
    n = {"abcdefg": 1, "abcdefh": 10, "abcdeih": 100, "abcjeih": 1000, "akcjeih": 10_000, "lkcjeih": 100_000}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {r.root for r in spelling.group_variants(df).collect()} == {"lkcjeih"}


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()] + [(77, "Wordswordſ \xd7\xf7\xd7\xf7\xd7\xf7\xd7\xf7 \xd7\xf7\xd7\xf7\xd7\xf7\xd7\xf7 ÀÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀÀ àààààààà " + "q" * 5000 + " " + "q" * 5000)]
    got = table(spelling.group_variants(spelling.count_words(documents(spark, rows))))
    assert got == brute(words_of(rows)) and got
    assert table(spelling.group_variants(spelling.count_words(empty(spark)))) == set()
