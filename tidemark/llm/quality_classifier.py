"""Quality classifier: a sparse ensemble of rules over document statistics.

A small forest is grown on labelled rows; each path from a root is a conjunctive rule. A logistic regression with lasso
penalty weighs the rules and leaves most of them out. What is left is one Spark column expression over the statistics, so
scoring needs no model object.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, materialise, text_or_empty

#: Labelled rows that training takes at most, those of least hash.
MOST_TRAINING = 20_000
TREES, DEPTH, LASSO, SEED = 24, 4, 0.002, 7
STATISTICS = ("log_words", "log_chars", "word_length", "longest_word", "upper", "digit", "symbol", "mark", "space", "wide", "distinct", "top_word", "short_words", "capital_words", "marked_words", "repeat_lines", "line_words")


def _bytes_in(s: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in s])


UPPER, DIGITS = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in("0123456789")
SYMBOLS, SPACES = _bytes_in("#*$%&|<>"), _bytes_in(" \t\n\v\f\r")
MARKS = _bytes_in("!\"'()+,-./:;=?@[\\]^_`{}~")


def statistics(text: str) -> tuple[float, ...]:
    """STATISTICS of a text of any length; an empty one has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    n = max(1, len(data))
    words = data.split()
    w = max(1, len(words))
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    lengths = np.fromiter(map(len, words), "i8", len(words))
    capital = marked = 0
    for word, k in seen.items():
        capital += k * word[:1].isupper()
        marked += k * (word[-1] in b"#*$%&|<>!" or word[0] in b"#*$%&|<>!")
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        float(np.log1p(len(words))), float(np.log1p(len(text))), float(lengths.mean()) if words else 0.0, float(np.log1p(lengths.max())) if words else 0.0,
        *(float(counts[c].sum() / n) for c in (UPPER, DIGITS, SYMBOLS, MARKS, SPACES)), float(counts[128:].sum() / n),
        len(seen) / w, top / w, float((lengths <= 3).sum() / w), capital / w, marked / w, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(w / max(1, len(lines)))),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each row of docs (doc_id, text), as a shared-folder table. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATISTICS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialise(in_arrow(rows, run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)), "statistics")


def in_training(doc_id: Column) -> Column:
    """Whether labels of a document may be learnt from: its remainder is not the held-out one."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text, so it is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


Rule = tuple[tuple[int, str, float], ...]


@dataclass
class RuleEnsemble:
    """Log-odds: intercept and a weight for each rule that holds; a rule is tests (statistic, "<=" or ">", bound), all true."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as an expression over the columns STATISTICS."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for k, sign, bound in rule:
        out = out & ((F.col(STATISTICS[k]) <= bound) if sign == "<=" else (F.col(STATISTICS[k]) > bound))
    return out


def paths(node, test: Rule = ()) -> Iterator[Rule]:
    """The rules of a grown tree's node: the path to each node below it."""
    if test:
        yield simplified(test)
    if node.getClass().getSimpleName() == "InternalNode":
        k, bound = node.split().featureIndex(), node.split().threshold()
        yield from paths(node.leftChild(), (*test, (k, "<=", bound)))
        yield from paths(node.rightChild(), (*test, (k, ">", bound)))


def simplified(test: Rule) -> Rule:
    """One bound for each statistic and side, in order."""
    bounds: dict[tuple[int, str], float] = {}
    for k, sign, bound in test:
        old = bounds.get((k, sign), bound)
        bounds[k, sign] = min(old, bound) if sign == "<=" else max(old, bound)
    return tuple(sorted((k, sign, bound) for (k, sign), bound in bounds.items()))


def train(measured: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> RuleEnsemble:
    """Learn from labels (doc_id, quality) of a measure() table. Null labels and ids are left out; labels of one class, or none,
    give an ensemble without rules at that class's probability (0.5 for none)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("label")).where(in_training(F.col("doc_id")))
    # Those of least hash; a bound on the hash first, which leaves about twice as many, so that not every task sends its own most.
    rows = measured.join(known, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    if (found := rows.select("doc_id").distinct().count()) > 2 * most + 1000:  # labels without a document do not count
        rows = rows.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * (2 * most + 1000) / found)))
    rows = rows.orderBy("h", "doc_id", "label", *STATISTICS).limit(most)
    sample = materialise(rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS).coalesce(1), "training")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="0.5", maxBins=64, seed=SEED, cacheNodeIds=False).fit(sample.select("label", "features"))
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._java_obj.rootNode())})
    if not rules:
        return RuleEnsemble(float(np.log(ones / (n - ones))))
    held = materialise(sample.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features")), "rules")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(held)
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6])


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) for each row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Only the text makes a score: null and empty texts have that of zero statistics. Other columns are not read.
    """
    measured = measure(docs)
    score = train(measured, labels, most).score()
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents scored by labels.quality."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
