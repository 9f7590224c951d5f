"""Quality rules on DataFrame functions alone: length and repetition, and how far a text's histograms lie from its language's.

Two histograms of a document are held against references by Jensen-Shannon distance (base 2, so from 0 to 1): character
classes, and the most common words of its language with one bin for all other words. A short text's
histogram strays from its source by chance, about as 1 / sqrt(length); the limits allow for that, and texts below
the guards are not judged by that histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Guards and limits: a distance may be up to LIMIT + SLACK / sqrt(length).
CLASS_GUARD, CLASS_LIMIT, CLASS_SLACK = 150, 0.12, 3.0
WORD_GUARD, WORD_LIMIT, WORD_SLACK = 80, 0.14, 1.1
# Shares of characters in prose by class, the same for the languages below.
CLASSES = {"other": 0.796, "upper": 0.015, "digit": 0.002, "mark": 0.024, "symbol": 0.0, "space": 0.163}
CLASS_PATTERNS = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]+", "symbol": "[#*$%&|<>]+"}
# The most common words of prose and their shares of all words.
COMMON = {
    "de": {"der": 0.05, "die": 0.026, "und": 0.021, "in": 0.0155, "den": 0.0133, "von": 0.0106, "zu": 0.0092, "das": 0.0087, "mit": 0.0074, "sich": 0.007, "des": 0.006, "auf": 0.0058},
    "en": {"the": 0.05, "of": 0.026, "and": 0.021, "to": 0.0155, "a": 0.0127, "in": 0.0108, "is": 0.0096, "that": 0.0085, "it": 0.0073, "for": 0.0071, "was": 0.0062, "on": 0.006},
    "es": {"de": 0.051, "la": 0.026, "que": 0.02, "el": 0.0152, "en": 0.0131, "y": 0.0106, "los": 0.0097, "se": 0.0084, "las": 0.0074, "del": 0.007, "por": 0.0063, "un": 0.0061},
    "fr": {"de": 0.051, "la": 0.027, "le": 0.02, "et": 0.0155, "les": 0.0129, "des": 0.011, "en": 0.0098, "un": 0.0087, "du": 0.0071, "une": 0.0066, "que": 0.006, "pour": 0.0058},
}


def _distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of counts / total from shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def term(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return part(p, m) + part(q, m)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, b: a + b) / 2))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more."""
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n.cast("int") - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # In order of hash, equal windows are neighbours.
        twice = lambda p: F.filter(p, lambda e, k: (F.get(p, k - 1)["h"] == e["h"]) | (F.get(p, k + 1)["h"] == e["h"]))
        places = F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(twice(p), lambda e: e["i"])))[0]
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])

    # Most texts repeat no window: for them the hashes are only counted.
    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)))[0]


def measures(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text, lang) its row as struct doc and its measures and verdicts.

    Null texts count as empty: no words, base_failed. lang only picks the reference; other or null languages are judged by
    character classes alone. Columns of docs keep out of the way in doc, whatever their names.
    """
    # row is not deterministic for the optimiser, so a filter on it stays above; else it would go below each step and
    # repeat there, many times over, what the step computes once.
    row = F.monotonically_increasing_id().alias("row")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), docs["lang"].cast("string").alias("lang"), row)
    split = own.select("doc", "text", "lang", row, F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"), *[(F.length("text") - F.length(F.regexp_replace("text", p, ""))).alias(k) for k, p in CLASS_PATTERNS.items()])
    every = sorted({w for words in COMMON.values() for w in words})
    by_lang = lambda kind: F.coalesce(*[F.when(F.col("lang") == g, F.array(*[F.lit(x) for x in kind(COMMON[g])])) for g in COMMON])
    counted = split.select(
        "doc", row, F.length("text").cast("long").alias("chars"), F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(_repeat_words(F.col("words"), F.size("words")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter("words", lambda w: w.isin(every)).alias("common"), by_lang(list).alias("ref_words"), by_lang(lambda x: [*x.values(), 1 - sum(x.values())]).alias("ref_shares"), *CLASS_PATTERNS,
    )
    spaces = F.col("chars") - F.col("word_chars")
    classes = [F.col("word_chars") - sum((F.col(k) for k in CLASS_PATTERNS), F.lit(0)), *[F.col(k) for k in CLASS_PATTERNS], spaces]
    class_counts = F.array(*[c.cast("double") for c in classes])
    hits = F.transform("ref_words", lambda r: F.size(F.filter("common", lambda w: w == r)).cast("double"))
    word_counts = F.transform(F.array(hits), lambda h: F.concat(h, F.array(F.col("n_words").cast("double") - F.aggregate(h, F.lit(0.0), lambda a, b: a + b))))[0]
    judged = counted.select(
        "doc", row, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("chars") >= CLASS_GUARD, _distance(class_counts, F.col("chars").cast("double"), F.array(*[F.lit(x) for x in CLASSES.values()])) - CLASS_SLACK / F.sqrt("chars")).alias("class_distance"),
        F.when(F.col("n_words") >= WORD_GUARD, _distance(word_counts, F.col("n_words").cast("double"), F.col("ref_shares")) - WORD_SLACK / F.sqrt("n_words")).alias("word_distance"),
    )
    strays = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT)
    return judged.drop("row").withColumns({"kept": ~F.col("base_failed") & ~strays, "row": row})


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass the rules, with the columns of docs. Null and empty texts do not pass; equal rows fare alike."""
    return measures(docs).where("kept AND row >= 0").select("doc.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents: the measures of the base rules and the verdict."""
    return measures(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    patterns = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{k}" for k, p in CLASS_PATTERNS.items())
    words = "CASE lang " + " ".join(f"WHEN '{g}' THEN [{', '.join(repr(w) for w in x)}]" for g, x in COMMON.items()) + " END"
    shares = "CASE lang " + " ".join(f"WHEN '{g}' THEN [{', '.join(repr(float(v)) for v in [*x.values(), 1 - sum(x.values())])}]::DOUBLE[]" for g, x in COMMON.items()) + " END"
    names = list(CLASS_PATTERNS)
    classes = f"[word_chars - {' - '.join('c_' + k for k in names)}, {', '.join('c_' + k for k in names)}, chars - word_chars]"
    distance = lambda counts, total, ref: f"""sqrt(greatest(0, list_sum(list_transform(list_zip({counts}, {ref}), lambda z:
        CASE WHEN z[1] > 0 THEN z[1] / {total} * log2((z[1] / {total}) / ((z[1] / {total} + z[2]) / 2)) ELSE 0 END
        + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] / {total} + z[2]) / 2)) ELSE 0 END)) / 2))"""  # noqa: E731
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, {patterns} FROM d),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, i - coalesce(prev, -8))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM twice) GROUP BY doc_id),
m AS (SELECT w.*, len(w) AS n_words, length(t) AS chars, length(array_to_string(w, '')) AS word_chars, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, {words} AS rw, {shares} AS rs FROM w LEFT JOIN rep USING (doc_id)),
h AS (SELECT *, list_transform(rw, lambda r: len(list_filter(w, lambda x: x = r))) AS hits FROM m),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN chars >= {CLASS_GUARD} THEN {distance(f"{classes}::DOUBLE[]", "chars", f"{list(CLASSES.values())}::DOUBLE[]")} - {CLASS_SLACK} / sqrt(chars) ELSE 0 END AS cd,
  CASE WHEN n_words >= {WORD_GUARD} AND rw IS NOT NULL THEN {distance("list_append(hits, n_words - list_sum(hits))::DOUBLE[]", "n_words", "rs")} - {WORD_SLACK} / sqrt(n_words) ELSE 0 END AS wd FROM h)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (cd > {CLASS_LIMIT} OR wd > {WORD_LIMIT}) AS kept FROM j
"""


OP8_SQL = _sql()
