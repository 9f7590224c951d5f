"""The pipeline's stages on planted rows, and the registered queries with SQL."""

import random

import public_tokenizers  # noqa: F401
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.test_queries import duck, rows  # noqa: F401
from tidemark.llm.registry import ORACLE_SQL, QUERIES

from .rows import LONG, documents


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 AND toxic = 0")
    good = [r.text for r in source.join(labels, "doc_id").where("n_chars BETWEEN 800 AND 6000 AND lang = 'en' AND text NOT RLIKE '[0-9]'").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    texts = [(i, t) for i, t in enumerate(good[:10])] + [(100, good[0]), (101, good[10] + " " + item), (102, "### $$$ %%% " * 40), (103, "again " * 100), (104, good[11] + " write to someone@mail1.example.com now")]
    docs, seen = documents(spark, texts), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = {r.doc_id for r in docs.collect()}
        assert name == "best_fit_packing" or docs.columns == columns
    assert {102, 103}.isdisjoint(seen["quality_rules"]) and 100 not in seen["simhash_near_dedup"] and 0 in seen["simhash_near_dedup"]
    assert 101 not in seen["decontamination"] and 101 in seen["simhash_near_dedup"] and 104 in seen["pii"] and seen["best_fit_packing"] == seen["pii"]
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert "[EMAIL]" in text[104] and "example.com" not in text[104]
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for doc in seen["best_fit_packing"]:
        pieces = sorted(docs.where(docs.doc_id == doc).collect(), key=lambda r: r.piece)
        assert [i for p in pieces for i in p.ids] == t.encode(text[doc], add_special_tokens=False).ids + [0]


def test_run_on_odd_rows(spark, tmp_path):
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id")
    good = [r.text for r in good.where("n_chars BETWEEN 2000 AND 6000 AND lang = 'en' AND text NOT RLIKE '[0-9]'").orderBy("doc_id").limit(9).collect()]
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3)
    item = benchmark.orderBy("item_id").first().text
    long = "\n".join(good[:8]) + "\n" + "\n".join(x[::-1] for x in good[:8]) * 8
    texts = [(1, None), (2, ""), (3, " \n"), (4, good[0]), (4, good[0]), (5, good[0]), (None, good[1]), (None, good[1]), (6, good[2]), (7, good[3] + "\n" + item), (8, LONG), (9, "word"), (10, good[4] + " a.b@mail1.example.com"), (11, long)]
    odd = documents(spark, texts)
    for name, rows, items in (("odd", odd, benchmark), ("empty", odd.limit(0), benchmark), ("no items", odd, benchmark.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {4, None, 6, 10} <= {r.doc_id for r in out} <= {4, None, 6, 10, 11} and all(1 <= r.length <= 2048 for r in out)
    assert sum(r.doc_id == 4 and r.piece == 0 for r in out) == 1 and sum(r.doc_id is None and r.piece == 0 for r in out) == 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert 7 in {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/no items").collect()}


def test_columns_of_documents_may_have_any_name(spark):
    taken = ["doc", "row_id", "row_key", "gone_id", "gone_key", "_key", "_id", "key", "root", "cls", "fp", "rank", "bases", "part"]
    docs = documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")]).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("mine").alias(c) for c in taken])
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, *(r[c] for c in taken)) for r in kept.collect()) == [(1, *["mine"] * len(taken)), (3, *["mine"] * len(taken))]


def test_near_dedup_stage_is_that_of_all_pairs(spark):
    r = random.Random(11)
    texts = []
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 400))]
        texts.append(" ".join(words))
        for changes in range(1, 1 + max(1, len(words) // 45)):
            near = words[:]
            for place in r.sample(range(len(near)), changes):
                near[place] = "changed"
            texts.append(" ".join(near))
    # Many edits of one text, about as similar to it as counts, less so to each other; and edits of those.
    base = [f"b{r.randrange(5000)}" for _ in range(300)]
    for k in range(70):
        near = base[:]
        for place in r.sample(range(300), r.randint(3, 16)):
            near[place] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(near + [f"end{j}" for j in range(k % 3 * 8)]))
        for _ in range(k % 4):
            closer = near[:]
            for place in r.sample(range(300), r.randint(1, 5)):
                closer[place] = f"y{r.randrange(10**6)}"
            texts.append(" ".join(closer))
    texts += ["", None, "two words", "Two  words", "two others"]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    sets = [shingles((t or "").lower().split()) for t in texts]
    root = list(range(len(texts)))
    similarities = []
    for i in range(len(texts)):
        for j in range(i):
            similarities.append(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
            if similarities[-1] >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    assert sum(0.8 <= x < 0.95 for x in similarities) > 50 and sum(0.6 < x < 0.8 for x in similarities) > 20
    first = {}
    for i, x in enumerate(root):
        first.setdefault(x, i)
    kept = corpus_pipeline.near_dedup(spark, documents(spark, list(enumerate(texts))), "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(first.values())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, tables, name):  # noqa: F811
    got, want = QUERIES[name](spark, tables).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_all_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 11)} and list(corpus_pipeline.QUERIES) == ["pipeline"]


def many(n, words=12):
    """n different short texts, of which every third is a near copy of the one before it."""
    r, texts = random.Random(5), []
    for i in range(n):
        texts.append(" ".join(f"w{r.randrange(10**6)}" for _ in range(words)) if i % 3 else (texts[-1] if texts else "w") + f" {i}")
    return texts


@pytest.fixture
def small_broadcasts(spark):
    """What the planner takes for 1 MB at most, and so broadcasts, fails where it is over 48 MB (a hash table has 32 MB here at the least)."""
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxBroadcastTableSize")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")
    yield
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stage_2_sends_no_exploded_rows_through_the_driver(spark, small_broadcasts):
    texts = many(12_000)
    kept = corpus_pipeline.near_dedup(spark, documents(spark, list(enumerate(texts))), "")
    # A text with one word more has 8 of 9 shingles in common with the one before it.
    assert sorted(x.doc_id for x in kept.collect()) == [i for i in range(12_000) if i == 0 or i % 3]
