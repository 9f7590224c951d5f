"""Small documents with every odd case, and helpers."""

LONG = "the of and to in that word " * 30_000
WORDS = " ".join(f"word{i} and the thing{i * 7 % 13} of" for i in range(60))
NEAR = WORDS + " end"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row int, doc int, key string, fp int, _id int, grams string"


def documents(spark, texts):
    """Documents with columns whose names operators use themselves; texts are (doc_id, text)."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", None if t is None else len(t), "w", 1, 2, "k", 3, 4, "g") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    texts = [(1, WORDS), (2, WORDS), (2, WORDS), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (None, WORDS + " x y z"), (None, None), (7, LONG), (8, "one"), (9, "a\x1cb　c\x85 d"), (10, "Ünïcödé " * 50)]
    return documents(spark, texts)


def empty(spark):
    return documents(spark, [(1, "x")]).where("doc_id > 1")
