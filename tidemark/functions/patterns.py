"""Lists of search patterns as column expressions.

A pattern that is a literal, at the text's start or anywhere, needs no regular expression: a start becomes a prefix test, which goes to the Parquet scan as
a filter, and many literals become one expression that shares their beginnings, so a text is read once however many there are.

Patterns are written for engines where classes are Unicode, a dot excludes only a line feed and a last $ means the end of the
text; Java needs flags and \\z for that. Look-around and back references are refused, as such engines have neither.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REFUSED = re.compile(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]")


class PatternError(ValueError):
    """A pattern that cannot be used."""


def for_java(pattern: str) -> str:
    if REFUSED.search(pattern):
        raise PatternError(f"look-around or back reference in {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(f"{pattern!r}: {e}") from e
    body = pattern
    if body.endswith("$") and (len(body) - 1 - len(body[:-1].rstrip("\\"))) % 2 == 0:
        body = body[:-1] + r"\z"
    return "(?U)(?d)" + body


def check_all(patterns: list[str]) -> list[str]:
    """The patterns for Java; PatternError names the first that is none."""
    return [for_java(p) for p in patterns]


#: Literals sought anywhere, from which number on they become one expression.
MANY = 4
ESCAPED = re.compile(r"\\([^0-9A-Za-z])")


def literal(pattern: str) -> tuple[bool, str] | None:
    """(whether it stands at the start, the text) of a pattern that is a literal, else None."""
    anchored = pattern.startswith("^")
    body = pattern[1:] if anchored else pattern
    plain = ESCAPED.sub("", body)
    if re.search(r"[\\^$.|?*+()\[\]{}]", plain):
        return None
    return anchored, ESCAPED.sub(r"\1", body)


def shared_beginnings(literals: list[str]) -> str:
    """A regular expression that finds any of some literals, each beginning that several share once: a tree of them, written out."""
    tree: dict = {}
    for text in literals:
        at = tree
        for c in text:
            if "" in at:  # a shorter one ends here
                break
            at = at.setdefault(c, {})
        else:
            at.clear()
            at[""] = {}

    def written(at: dict) -> str:
        parts = []
        for c, below in sorted(at.items()):
            run = c
            while len(below) == 1 and "" not in below:
                ((c, below),) = below.items()
                run += c
            parts.append(re.escape(run).replace("\\ ", " ") + (written(below) if below and "" not in below else ""))
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return written(tree)


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether a pattern is found anywhere in text; false for an empty list, null for a null text and some pattern."""
    checked = list(zip(check_all(patterns), map(literal, patterns)))
    starts = sorted({x[1] for _, x in checked if x and x[0]})
    anywhere = sorted({x[1] for _, x in checked if x and not x[0]})
    out = F.lit(False)
    for t in starts:
        if not any(t != s and t.startswith(s) for s in starts):  # a shorter start covers it
            out = out | F.startswith(text, F.lit(t))
    if len(anywhere) < MANY or "" in anywhere:
        for t in anywhere:
            out = out | F.contains(text, F.lit(t))
    else:
        out = out | text.rlike(shared_beginnings(anywhere))
    for p, x in checked:
        if not x:
            out = out | text.rlike(p)
    return out


def first_match(text: Column, patterns: list[str]) -> Column:
    """The place in the list of the first pattern that is found, else null."""
    out = F.lit(None).cast("long")
    for k, (p, x) in reversed(list(enumerate(zip(check_all(patterns), map(literal, patterns))))):
        found = text.rlike(p) if not x else F.startswith(text, F.lit(x[1])) if x[0] else F.contains(text, F.lit(x[1]))
        out = F.when(found, F.lit(k).cast("long")).otherwise(out)
    return out


def included(text: Column, include: list[str], exclude: list[str], empty_means_all: bool) -> Column:
    """Include and exclude lists, of which exclusion wins."""
    wanted = F.lit(True) if empty_means_all and not include else any_match(text, include)
    return wanted & ~any_match(text, exclude)


def public_read(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a file gets a public ACL: blank patterns do not count, and without any nothing does."""
    return included(path, [p for p in include if p.strip()], [p for p in exclude if p.strip()], empty_means_all=False)
