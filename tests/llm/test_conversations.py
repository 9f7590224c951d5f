"""Repair of conversations against a search over all edits, in segments of any size, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, part int, k int, copies string"


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (conv_id, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            yield from [row] * (1 + (h == 3))


def repaired(rows):
    """The contract's columns for the rows of one conversation after damage, by a search over (place, state) for the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @cache
    def best(i, done, added):
        """Least (cost, audit, lines) from row i on; done: whether and which role came last."""
        out = []
        if i == n and done in ("", "a"):
            out.append((0, "", ()))
        fits = "a" if done == "u" else "u"
        name = {"u": "user", "a": "assistant"}[fits]
        if added < 2:
            c, audit, lines = best(i, fits, added + 1)
            out.append((c + 5, "I" + audit, (f"{name}:",) + lines))
        if i < n:
            c, audit, lines = best(i + 1, done, 0)
            out.append((c + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                _, _, role, text = rows[i]
                if role[:1] == fits or role[:1] == "s" and done == "":
                    c, audit, lines = best(i + 1, role[0], 0)
                    out.append((c + more, "K" + audit, (f"{role}:{text}",) + lines))
                c, audit, lines = best(i + 1, fits, 0)
                out.append((c + more + 1, "R" + audit, (f"{name}:{text}",) + lines))
        return min(out, default=(1 << 50, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = {t for _, t, *_ in rows if t is not None}
    count = Counter(faults)
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: repaired(v) for k, v in groups.items()}


def table(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def made(seed, conversations=60, longest=14):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", "sys", "User", None], ["Yes.", "No", " \t\n", "", "So?\x0b", "x y!", "ok", None, "a\x1c"]
    rows = []
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            rows.append((c or None, r.choice([t, t, t, t + 3, None]), r.choice(roles[: r.choice([3, 8])]), r.choice(texts) if r.random() < 0.5 else f"text {r.randint(0, 99)}."))
    return rows


def plain(rows):
    return [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]


@pytest.mark.parametrize("seed", range(3))
def test_repairs_are_the_cheapest(spark, seed):
    rows = made(seed)
    assert table(cv.repair_conversations(messages(spark, rows))) == brute(plain(rows))


@pytest.mark.parametrize("size", [1, 3])
def test_segments_of_any_size(spark, monkeypatch, size):
    """Small segments in this process: matrices, costs behind them, traces over their bounds."""
    monkeypatch.setattr(cv, "SEGMENT", size)

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    monkeypatch.setattr(cv, "TaskContext", Task)
    rows = plain(made(7, 40, 25))
    ordered = cv.with_faults(messages(spark, rows)).coalesce(1).sortWithinPartitions("conv_id", "turn", "role", F.left("text", F.lit(256)), "digest").drop("digest").toArrow()
    scanned = [r for b in cv.scan_sorted(iter(ordered.to_batches())) for r in b.to_pylist()]
    segments = [r for r in scanned if r["k"] is not None]
    assert len(segments) > 150

    def batch(rows, *names):
        return iter([cv.pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows])])

    key = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0)
    backward = sorted(sorted(segments, key=lambda r: (r["part"], r["k"]), reverse=True), key=key)
    costs = {(r["part"], r["k"], r["conv_id"]): r["costs"] for b in cv.costs_behind(batch(backward, "conv_id", "part", "k", "matrix")) for r in b.to_pylist()}
    forward = [r | {"costs": costs[r["part"], r["k"], r["conv_id"]]} for r in sorted(segments, key=lambda r: (*key(r), r["part"], r["k"]))]
    names = ["conv_id", "symbols", "roles", "texts", "costs", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"]
    got = [r for b in cv.repair_segments(batch(forward, *names)) for r in b.to_pylist()] + [r for r in scanned if r["k"] is None]
    assert {r["conv_id"]: tuple(r[c] for c in cv.RESULT.names[1:]) for r in got} == brute(rows)


def test_one_long_conversation(spark):
    """It is spread over tasks; a fifth of it is one message."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "tool"]), f"{r.randint(0, 3000)} is it?" if t % 5 else "Again.") for t in range(30_000)] + [(2, 0, "user", "a.")] * 9000
    got = table(cv.repair_conversations(messages(spark, rows)))
    assert got[2] == (0, 0, 8999, 0, 8999, 2 * 9000, "D" * 9000, hashlib.sha256(b"").hexdigest())
    seen = {(role, text) for _, _, role, text in rows[:30_000]}
    assert got[1][2] == 30_000 - len(seen) and len(got[1][6].replace("I", "")) == 30_000
    small = rows[:250] + [(2, 0, "user", "a.")] * 30
    assert table(cv.repair_conversations(messages(spark, small))) == brute(small)


def test_automaton_is_small():
    a, r = cv.Determinised(), random.Random(1)
    for _ in range(200):
        a.scan(bytes(r.choices(range(12), k=500)), a.state(tuple(cv.END))[0])
    assert len(a.vectors) < 300 and a._steps


def test_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damaged(rows))
    got = table(cv.op12_conversation_repair(spark, tables))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, nothing) for c, *_ in rows} and len(got) > 10


def test_damage_and_empty_tables(spark):
    rows = [(c, t, role, text) for c in (None, 1, 2, 30) for t in (None, *range(40)) for role, text in [("user", "a.b!?"), (None, None)]]
    key = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r)
    got = [tuple(r) for r in cv.damage(messages(spark, rows)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=key) == sorted(damaged(rows), key=key)
    none = messages(spark, rows).where("turn > 99")
    assert cv.repair_conversations(cv.damage(none)).count() == 0
