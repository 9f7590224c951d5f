"""Token ids by the tokenizers library, exact and with each repeated piece of text encoded once.

A byte-level pre-tokenizer always cuts before a white-space character that another character follows, and
looks at nothing to the left of a cut. So a text may be cut there, each chunk encoded by itself, and the ids put
together: they equal those of the whole text (tests compare both). Most texts have single spaces between words: those are cut at
their spaces alone, and a piece between two spaces is cut further only when it is new. Pieces repeat, so their ids are
kept in a table of the worker process, in two generations: when the younger is full the older one goes,
and what is asked for again moves over.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Unicode's White_Space; Python's \\s has four control characters more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space up to its last character; a character of white space with the word after it; the rest.
CHUNK = re.compile(f"[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+")
#: A line's end, Latin letters, ASCII marks: a pre-token each.
PLAIN = re.compile("(\n?)((?:(?<!\\n) )?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: The same marks (no apostrophe, which may begin a pre-token of letters) and the last letter, for pieces between spaces.
MARKS, LAST = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "\xff"
#: Pieces in a generation: some 240 MB of a worker process for two.
KEEP = 600_000
#: Longer pieces are encoded each time.
LONGEST_KEPT = 64


def byte_letters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generation(dict):
    """Ids of pieces. A key is what follows a space, without it, or what follows none, with a space at its end."""

    def __init__(self, encoder: PieceEncoder, old: dict[str, bytes]):
        self.new, self.merge, self.id_bytes, self.old = encoder._new, encoder.merge, encoder.id_bytes, dict(old)

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            if piece.isalpha() and piece.isascii():
                ids = self.id_bytes
                out = b"".join([ids[x.id] for x in self.merge("\u0120" + piece)])
            else:
                out = self.new(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = out
        return out


class PieceEncoder:
    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.cuts = isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and isinstance(t.model, models.BPE) and t.normalizer is None and not t.pre_tokenizer.add_prefix_space
        self.letters = byte_letters()
        self.merge = t.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(t.get_vocab_size() + 1)]
        self.line_end = self.whole("\n") if self.cuts else b""
        self.keep, self.kept = keep, Generation(self, {})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        if word.isascii():
            form = "\u0120" + word[1:] if word[0] == " " else word
        else:
            form = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[x.id] for x in self.merge(form)])

    def _pre_token(self, word: str) -> bytes:
        return self.kept[word[1:] if word[0] == " " else word + " "]

    def _chunk(self, chunk: str) -> bytes:
        if m := PLAIN.fullmatch(chunk):
            end, word, marks = m.groups()
            return (self.line_end if end else b"") + self._pre_token(word) + (self._pre_token(marks) if marks else b"")
        return self.whole(chunk)

    def _cut(self, text: str) -> bytes:
        return b"".join([self._chunk(c) for c in CHUNK.findall(text)])

    def _new(self, piece: str) -> bytes:
        if piece[-1:] == " ":
            return self._merged(piece[:-1])
        word = piece.rstrip(MARKS)
        if not word.isalpha() or not word.isascii() and max(word) > LAST:
            return self._cut(" " + piece)
        if len(word) == len(piece):
            return self._merged(" " + word)
        return self.kept[word] + self._pre_token(piece[len(word) :])  # the word by itself may be known

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if not self.cuts or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.kept) > self.keep:
            self.kept = Generation(self, self.kept)
        if "  " in text or text[-1:] == " ":  # spaces side by side belong together
            return self._cut(text)
        first, *pieces = text.split(" ")
        return self._cut(first) + b"".join(map(self.kept.__getitem__, pieces))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
