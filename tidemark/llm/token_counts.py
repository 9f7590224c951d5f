"""Token counts of documents under a unigram vocabulary, by dynamic programming shared over a trie.

The count of a text is the sum over its pre-tokens, which make it up without a gap: a word with the space before it, if there is one, or
a run of other white space. A pre-token's count is the number of pieces in its likeliest segmentation. Distinct pre-tokens in byte order are a trie walked depth first: what one shares with
the one before it is a path already walked, and the forward scores along that path are kept on a stack. So the scores of each
shared prefix are computed once, in memory that follows the longest pre-token. Counts of pre-tokens, the trie's terminals, stay in
a bounded table of the worker process, as pre-tokens come back in later batches.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, text_or_empty
from .tokens import SPACE

#: A piece of rank r has probability in proportion to 1 / (r + OFFSET).
OFFSET = 2.7
#: Pre-tokens whose counts a worker keeps; the table is emptied when it is full.
KEEP = 800_000
PRE_TOKEN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?= [^{SPACE}])|[{SPACE}]+")


class Unigrams:
    def __init__(self, path: str):
        """From a file of ranks: a line for each piece, in base64, and its rank. Every single byte must be a piece."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        norm = math.log(sum(1 / (r + OFFSET) for r in ranks.values()))
        self.scores = {p: -math.log(r + OFFSET) - norm for p, r in ranks.items()}
        if len([p for p in self.scores if len(p) == 1]) < 256:
            raise ValueError(f"{path} does not have every single byte")
        # The trie of reversed pieces: each ending of a piece, with its score or, if it is none itself, None.
        self.endings: dict[bytes, float | None] = {p[k:]: None for p in self.scores for k in range(1, len(p))} | self.scores
        self.kept: dict[str, int] = {}

    def terminals(self, pre_tokens: Iterable[bytes]) -> dict[bytes, int]:
        """The number of pieces of each pre-token. Of equally likely segmentations the one with fewest pieces counts."""
        get, out = self.endings.get, {}
        score, pieces, last = [0.0], [0], b""
        for word in sorted(set(pre_tokens)):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, n = -math.inf, 0
                for begin in range(end - 1, -1, -1):
                    s = get(word[begin:end], 1.0)
                    if s == 1.0:  # no piece ends so, nor with more before it
                        break
                    if s is not None:
                        s += score[begin]
                        if s > best or s == best and pieces[begin] < n - 1:
                            best, n = s, pieces[begin] + 1
                score.append(best)
                pieces.append(n)
            out[word] = pieces[len(word)]
            last = word
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.kept) > KEEP:
            self.kept.clear()
        words = [Counter(PRE_TOKEN.findall(t)) for t in texts]
        new = {w.encode("utf-8", "surrogatepass"): w for c in words for w in c if w not in self.kept}
        found = {new[w]: n for w, n in self.terminals(new).items()}
        self.kept.update((w, n) for w, n in found.items() if len(w) <= 64)
        return [(c.total(), sum(k * (found[w] if w in found else self.kept[w]) for w, k in c.items())) for c in words]


_models: dict[str, Unigrams] = {}


def unigrams(path: str) -> Unigrams:
    if path not in _models:
        _models[path] = Unigrams(path)
    return _models[path]


#: Characters of texts whose pre-tokens go into one trie.
AT_ONCE = 4 << 20


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each row of docs (doc_id, text). Null and empty texts have none; other
    columns are not read. No shuffle: each task has its own trie of what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigrams(vocabulary)

        def counted(ids: list, texts: list[str]) -> pa.RecordBatch:
            n = model.count(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in n], pa.int64()), pa.array([x for _, x in n], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

        ids, texts, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > AT_ONCE:
                    yield counted(ids, texts)
                    ids, texts, held = [], [], 0
        yield counted(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_arrow(rows, run, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents' token counts."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
