"""Words that are spelling variants of more frequent ones.

Two words are near if one error (a code point more, fewer or other) parts them. The error lies before or after the middle of
the shorter one, so half of it stands exactly in both: a word of m code points seeks partners of m or m + 1 code points that share its first half, in
a minimal acyclic automaton of words, and partners that share its second half, in one of reversed words. The half is matched exactly, the rest
completed with one error, and perfect-hash numbers of the automata address the counts. An error's place is
the first code point where both words differ, so each pair is found in one direction and at one place: nothing is found twice.

Words that share a half go to one task under a key of it. A key of too many words is cut: the part where the error may
lie is halved and the half without it joins the key, again and again, down to a part of one code point, under which few words fit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, materialise, scratch_tables, text_or_empty

SHORTEST, LEAST = 7, 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: One of so many runs loses a code point (the contract's damage).
DAMAGE = 31
#: Words under one key, beyond which it is cut; words of an automaton, but for a key of more.
MOST, CHUNK = 20_000, 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def damaged(doc_id: str, run: str) -> str:
    """The run, without a code point where 31 divides the crc32 of `<doc_id>:<run>`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def lower_ascii(word: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return word.lower() if word.isascii() else "".join([c.lower() if c < "\x80" else c for c in word])


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damage: bool = True) -> DataFrame:
    """(word, n): words of docs (doc_id, text) of at least shortest code points with at least least occurrences in all. A word is a maximal
    run of Latin letters; a null text has none, a null doc_id counts as an empty one; damage deletes code points as `damaged` says."""
    runs_of = re.compile("[A-Za-zÀ-ÿ]{%d,}" % shortest).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: dict[str, int] = {}
                for run, n in Counter(runs_of(text.as_py())).items():
                    run = lower_ascii(run)
                    own[run] = own.get(run, 0) + n
                for run, n in own.items():
                    word = damaged(doc_id, run) if damage else run
                    if len(word) >= shortest:
                        seen[word] = seen.get(word, 0) + n
                if len(seen) > HELD:
                    yield hand_on()
        yield hand_on()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text"))
    return in_arrow(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a word's perfect-hash number is its place among them."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.before: list[dict[str, int]] = []  # of an arc: words that the state accepts by what sorts before it
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states of the last word, not yet known
        last = ""
        for word in words:
            k = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                k += 1
            self._close(path, last, k, known)
            for _ in range(k, len(word)):
                path.append(({}, [False]))
            path[-1][1][0] = True
            last = word
        self._close(path, last, 0, known)
        self.root = self._state(path[0], known)

    def _close(self, path: list, last: str, k: int, known: dict[tuple, int]) -> None:
        while len(path) > k + 1:
            state = self._state(path.pop(), known)
            path[-1][0][last[len(path) - 1]] = state

    def _state(self, made: tuple[dict[str, int], list[bool]], known: dict[tuple, int]) -> int:
        arcs, (final,) = made
        key = (final, *arcs.items())
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.arcs)
            n, before = int(final), {}
            for letter, to in arcs.items():
                before[letter] = n
                n += self._size[to]
            self.arcs.append(arcs)
            self.final.append(final)
            self.before.append(before)
            self._size.append(n)
        return state

    def number(self, word: str) -> int:
        """The place of a word that the automaton accepts."""
        state, n, arcs, before = self.root, 0, self.arcs, self.before
        for letter in word:
            n += before[state][letter]
            state = arcs[state][letter]
        return n

    def _accepts(self, state: int, rest: str) -> bool:
        arcs = self.arcs
        for letter in rest:
            state = arcs[state].get(letter, -1)
            if state < 0:
                return False
        return self.final[state]

    def one_error(self, word: str, replaced: range, inserted: range, back: int) -> Iterator[str]:
        """Accepted words that differ from an accepted one at one place: a code point replaced at a place in replaced, or inserted before one
        in inserted. What is inserted differs from the code point back places before (0: the next one, 1: the last one), else the place is another."""
        first, m = min(replaced.start, inserted.start), len(word)
        state, arcs, accepts = self.root, self.arcs, self._accepts
        for letter in word[:first]:
            state = arcs[state][letter]
        for j in range(first, inserted.stop):
            here = arcs[state]
            own = word[j] if j < m else ""
            if len(here) > (own in here):
                other = word[j - back] if 0 <= j - back < m else ""
                rest, all_of_it = word[j + 1 :], word[j:]
                for letter, to in here.items():
                    if j in replaced and letter != own and accepts(to, rest):
                        yield word[:j] + letter + rest
                    if j in inserted and letter != other and accepts(to, all_of_it):
                        yield word[:j] + letter + all_of_it
            elif j in inserted and back and own and own != word[j - 1] and accepts(here[own], word[j:]):
                yield word[:j] + own + word[j:]
            if j < m:
                state = here[own]


class Tally:
    """Counts of the words of one automaton: how many near words, and the most frequent of them."""

    def __init__(self, counts: dict[str, int], backward: bool):
        self.backward = backward
        self.words = sorted([w[::-1] for w in counts] if backward else counts)
        self.automaton = Automaton(self.words)
        self.n = [counts[w[::-1] if backward else w] for w in self.words]
        self.near = [0] * len(self.words)
        self.best = [-1] * len(self.words)

    def word(self, i: int) -> str:
        return self.words[i][::-1] if self.backward else self.words[i]

    def credit(self, i: int, other: int) -> None:
        self.near[i] += 1
        b = self.best[i]
        if b < 0 or self.n[other] > self.n[b] or self.n[other] == self.n[b] and self.word(other) < self.word(b):
            self.best[i] = other

    def seek(self, word: str, lo: int, hi: int) -> None:
        """Credit word, and longer partners, with the pairs whose error's place is in [lo, hi), or [lo, hi] at the word's end."""
        m = len(word)
        if self.backward:
            word, replaced, inserted = word[::-1], range(m - hi, m - lo), range(m - hi + 1, m - lo + 1)
        else:
            replaced, inserted = range(lo, hi), range(lo, hi + (hi == m))
        i = -1
        for x in self.automaton.one_error(word, replaced, inserted, int(self.backward)):
            i = self.automaton.number(word) if i < 0 else i
            k = self.automaton.number(x)
            self.credit(i, k)
            if len(x) > m:  # a shorter word seeks longer ones, not the other way round
                self.credit(k, i)


def _near_in(rows: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the best one's n, the best one) for rows (word, n, m, lo, hi) that hold whole keys."""
    for backward in (False, True):
        own = [r for r in rows if (r[3] < r[2] - r[4]) == backward]
        if own:
            tally = Tally({r[0]: r[1] for r in own}, backward)
            for word, _, m, lo, hi in own:
                if len(word) == m:
                    tally.seek(word, lo, hi)
            for i, near in enumerate(tally.near):
                if near:
                    yield tally.word(i), near, tally.n[tally.best[i]], tally.word(tally.best[i])


def _with_key(rows: DataFrame) -> DataFrame:
    """The key: the length, the part where the error may lie, and what stands before and after that part."""
    fixed = F.expr("concat(substring(word, 1, lo), '\\u0001', substring(word, length(word) - (m - hi) + 1, m - hi))")
    return rows.withColumn("key", F.concat_ws(":", "m", "lo", "hi", fixed))


def _parts(lo: str, hi: str) -> F.Column:
    middle = f"CAST(({lo} + {hi}) DIV 2 AS INT)"
    return F.expr(f"array(named_struct('lo', {middle}, 'hi', {hi}), named_struct('lo', {lo}, 'hi', {middle}))")


def word_keys(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, m, lo, hi, key) for words (word, n): pairs of near words meet under one key. A key has at most `most` words, or a part of one code point."""
    lengths = words.withColumn("m", F.explode(F.expr("array(length(word), length(word) - 1)")))
    rows = _with_key(lengths.withColumn("part", F.explode(_parts("0", "m"))).select("word", "n", "m", "part.*"))
    done: list[DataFrame] = []
    while True:
        large = materialise(rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > most).select("key"), "keys")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti").select(*rows.columns))
        halves = rows.join(large, "key", "left_semi").withColumn("part", F.explode(_parts("lo", "hi")))
        rows = materialise(_with_key(halves.select("word", "n", "m", "part.*")), "halves")
    for other in done:
        rows = rows.unionByName(other)
    return rows


def near_words(words: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, form, form_n) for words (word, n) with a near word: how many near words, and that of largest n (ties: least in code points)."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int, int, int]] = []
        last, begins = None, 0

        def found(rows: list) -> pa.RecordBatch:
            out = list(zip(*_near_in(rows))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "form_n", "form"])

        for batch in batches:
            for *row, key in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if len(held) - begins == 1:  # a key of one word
                        held.pop()
                    if len(held) >= chunk:
                        yield found(held)
                        held = []
                    last, begins = key, len(held)
                held.append(tuple(row))
        yield found(held)

    keyed = word_keys(words, most).repartition("key").sortWithinPartitions("key")
    found = in_arrow(keyed.select("word", "n", "m", "lo", "hi", "key"), seek, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("b"))
    return best.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): the last word on the way of forms. A form is RATIO times as frequent as its word, so
    ways are short and have no ring; each round doubles the steps."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialise(moved, "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def group_variants(words: DataFrame, ratio: int = RATIO, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), distinct, n positive, words of at least two code points; other columns are not read.

    form is the near word of largest n (ties: the least in code points) where that n is at least ratio times the word's, else null;
    root follows forms to the last, and is the word itself where it has none. No words, no rows.
    """
    with scratch_tables(words.sparkSession) as keep:
        words = materialise(words.select("word", "n"), "words")
        near = words.join(near_words(words, most, chunk), "word", "left")
        is_form = F.col("form_n") >= ratio * F.col("n")
        rows = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
        out = rows.join(roots(rows.where("form IS NOT NULL")), "word", "left")
        return keep(materialise(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The spelling variants among all words of all documents."""
    return group_variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
