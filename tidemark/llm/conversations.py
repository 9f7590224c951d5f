"""Repair of conversations whose turns are out of order, at the least cost of edits.

A repaired conversation is empty or a system message, if any, before pairs of user and assistant messages. Edits are a weighted automaton
over four states (nothing, after a system, user, assistant message): keep a message, give it the role that fits, delete it, or insert an
empty one. It is made deterministic lazily: read from the last message to the first, the costs from each state to
the end, less their minimum, are a state of the deterministic automaton, and each (state, kind of message) is worked out once for a worker process and
then looked up. The scan adds up the minima. The trace goes back over what was scanned, so from the first
message on, along tight arcs, the least letter first: that gives the least audit among the cheapest.

Conversations are sorted over all tasks by range, so one of any length is spread. A task scans them in segments of bounded size. One that
lies within a task and a segment is done at once. For the others a segment has a 4 by 4 matrix of costs; a pass over the
matrices from the last to the first gives each segment the costs behind it, and a pass over the segments in order traces them. That pass
holds one segment; a hash of the whole repaired text has no other order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, materialise, parallelism, scratch_tables

SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a message that a repair puts there, and its role.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A kept message's state, by its role's initial, and the states before it.
KEEPS = {0: (SYSTEM, (START,)), 1: (USER, (START, SYSTEM, ASSISTANT)), 2: (ASSISTANT, (USER,))}
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: What is wrong with a message, as it counts in its symbol: 3 * initial + this.
SOUND, CUT_SHORT, TO_DELETE = range(3)
NEVER = 1 << 40
#: Costs from each state to the end where no message is left.
END = [0, 2 * INSERT, INSERT, 0]
#: Messages, and characters of their text, in a segment.
SEGMENT, SEGMENT_TEXT = 8192, 2 << 20


class Determinised:
    """States are cost vectors less their minimum; what is asked for is worked out once and kept."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._known: dict[tuple[int, ...], int] = {}
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector, and its minimum."""
        least = min(costs)
        vector = tuple(c - least if c < NEVER else NEVER for c in costs)
        if vector not in self._known:
            self._known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._known[vector], least

    def _arcs(self, symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state after) of what may be done with a message, in the letters' order."""
        initial, fault = divmod(symbol, 3)
        arcs = [("D", DELETE, q)]
        if fault != TO_DELETE:
            more = TRUNCATED * (fault == CUT_SHORT)
            if initial in KEEPS and q in KEEPS[initial][1]:
                arcs.append(("K", more, KEEPS[initial][0]))
            arcs.append(("R", REROLE + more, NEXT[q]))
        return arcs

    def _before(self, behind: tuple[int, ...], symbol: int) -> list[int]:
        out = [min(min(NEVER, cost + behind[to]) for _, cost, to in self._arcs(symbol, q)) for q in range(4)]
        for _ in range(4):  # insertions before the message
            out = [min(out[q], INSERT + out[NEXT[q]]) for q in range(4)]
        return [min(NEVER, c) for c in out]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state with one message more in front, and what the minimum grows by."""
        found = self._steps.get((state, symbol))
        if found is None:
            found = self._steps[state, symbol] = self.state(tuple(self._before(self.vectors[state], symbol)))
        return found

    def scan(self, symbols: bytes, state: int) -> tuple[list[int], int]:
        """The states behind each message and before the first (in the messages' order), and the sum of minima."""
        states, total = [state], 0
        for symbol in reversed(symbols):
            state, more = self.step(state, symbol)
            states.append(state)
            total += more
        states.reverse()
        return states, total

    def trace(self, behind: int, symbol: int, q: int) -> tuple[str, int]:
        """The least letters of the cheapest edits up to and with a message, met in state q, and the state after it."""
        found = self._traces.get((behind, symbol, q))
        if found is None:
            vector, letters, at = self.vectors[behind], "", q
            costs = self._before(vector, symbol)
            while True:
                tight = [(letter, to) for letter, cost, to in self._arcs(symbol, at) if cost + vector[to] == costs[at]]
                if INSERT + costs[NEXT[at]] == costs[at]:
                    tight.append(("I", NEXT[at]))
                letter, to = min(tight)
                letters, at = letters + letter, to
                if letter != "I":
                    break
            found = self._traces[behind, symbol, q] = (letters, at)
        return found


_automata: list[Determinised] = []


def automaton() -> Determinised:
    """One for each worker process."""
    if not _automata:
        _automata.append(Determinised())
    return _automata[0]


def matrix(symbols: bytes) -> list[int]:
    """Costs from each state before the messages to each state behind them, row by row."""
    a, columns = automaton(), []
    for q in range(4):
        states, total = a.scan(symbols, a.state(tuple(0 if k == q else NEVER for k in range(4)))[0])
        columns.append([min(NEVER, c + total) for c in a.vectors[states[0]]])
    return [columns[k][q] for q in range(4) for k in range(4)]


def behind_segment(m: list[int], costs: list[int]) -> list[int]:
    """The costs before a segment of that matrix, from those behind it."""
    return [min(NEVER, *(m[4 * q + k] + costs[k] for k in range(4))) for q in range(4)]


class Repaired:
    """Takes the segments of one conversation in order; holds its audit and what is left of the hash."""

    def __init__(self):
        self.state, self.audit, self.hash, self.lines = START, [], hashlib.sha256(), 0
        self.cost = None

    def _line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.lines += 1

    def take(self, symbols: bytes, roles: list[str], texts: list[str], costs: list[int]) -> None:
        """roles and texts: of the messages that need not be deleted; costs: from each state behind the segment to the end."""
        a = automaton()
        state, least = a.state(tuple(costs))
        states, total = a.scan(symbols, state)
        if self.cost is None:
            self.cost = a.vectors[states[0]][START] + total + least
        kept = 0
        for symbol, behind in zip(symbols, states[1:]):
            letters, to = a.trace(behind, symbol, self.state)
            for letter in letters:
                if letter == "I":
                    self._insert()
            letter = letters[-1]
            if letter == "K":
                self._line(roles[kept], texts[kept])
            elif letter == "R":
                self._line(ROLE[to], texts[kept])
            self.state = to
            kept += symbol % 3 != TO_DELETE
            self.audit.append(letters)

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self._line(ROLE[self.state], "")

    def end(self) -> dict:
        while self.state in (SYSTEM, USER):
            self._insert()
            self.audit.append("I")
        return {"cost": self.cost or 0, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


class Segment:
    """Messages of one conversation in order, and their counts."""

    def __init__(self):
        self.symbols, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None

    def full(self) -> bool:
        return len(self.symbols) >= SEGMENT or self.size >= SEGMENT_TEXT

    def add(self, turn: int | None, role: str, text: str, initial: int, fault: str) -> None:
        if self.symbols:
            self.illegal += (self.symbols[-1] // 3, initial) not in LEGAL
        self.symbols.append(3 * initial + {"blank": TO_DELETE, "duplicate": TO_DELETE, "truncated": CUT_SHORT, "": SOUND}[fault])
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if fault not in ("blank", "duplicate"):
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self) -> dict:
        return {
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "symbols": bytes(self.symbols), "roles": self.roles, "texts": self.texts,
        }


class Totals:
    """Counts of a conversation, from those of its segments in order."""

    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.first_turn, self.last_turn, self.initial = 0, None, None, None

    def add(self, s: dict) -> None:
        for k in self.counts:
            self.counts[k] += s[k]
        if self.initial is not None:
            self.counts["illegal"] += (self.initial, s["symbols"][0] // 3) not in LEGAL
        self.initial = s["symbols"][-1] // 3
        if s["turns"]:
            self.turns += s["turns"] - (s["first_turn"] == self.last_turn)
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]

    def row(self) -> dict:
        return self.counts | {"gaps": self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0}


def _record_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


LONG = pa.int64()
RESULT = pa.schema([("conv_id", LONG)] + [(c, LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
#: A conversation that is done has no k; a segment has a part and a k, which order it within its conversation.
SCANNED = pa.schema(
    [*RESULT, ("part", LONG), ("k", LONG), ("turns", LONG), ("first_turn", LONG), ("last_turn", LONG), ("matrix", pa.list_(LONG)), ("symbols", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SCANNED_SQL = RESULT_SQL + ", part long, k long, turns long, first_turn long, last_turn long, matrix array<long>, symbols binary, roles array<string>, texts array<string>"


def scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's messages (conv_id, turn, role, text, initial, fault, copies) in order: done conversations, and segments of those that
    are longer than one or may go on in another task, the first and the last."""
    part, out, held = TaskContext.get().partitionId(), [], 0
    own, k, first, key, began, cut = Segment(), 0, True, None, False, False  # k: segments of the task so far

    def as_segment() -> dict:
        nonlocal k
        k += 1
        return own.row() | {"conv_id": key, "part": part, "k": k, "matrix": matrix(bytes(own.symbols))}

    for batch in batches:
        for conv_id, turn, role, text, initial, fault, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if not began or conv_id != key:
                if began:
                    if first or cut:
                        out.append(as_segment())
                    else:
                        totals, repaired = Totals(), Repaired()
                        totals.add(own.row())
                        repaired.take(bytes(own.symbols), own.roles, own.texts, END)
                        out.append({"conv_id": key} | totals.row() | repaired.end())
                    held += own.size + 300
                    first = False
                own, key, began, cut = Segment(), conv_id, True, False
            for copy in range(copies):
                if own.full():
                    out.append(as_segment())
                    held += own.size
                    own, cut = Segment(), True
                own.add(turn, role, text, initial, fault if not copy or fault == "blank" else "duplicate")
            if held > SEGMENT_TEXT:
                yield _record_batch(out, SCANNED)
                out, held = [], 0
    if began:
        out.append(as_segment())
    yield _record_batch(out, SCANNED)


def costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments (conv_id, part, k, matrix), each conversation's from its last to its first: the costs behind each."""
    began, key, costs = False, None, []
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if not began or r["conv_id"] != key:
                began, key, costs = True, r["conv_id"], END
            m, r["costs"] = r.pop("matrix"), costs
            costs = behind_segment(m, costs)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", LONG), ("part", LONG), ("k", LONG), ("costs", pa.list_(LONG))]))


def repair_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments with the costs behind them, each conversation's in order: the conversations."""
    began, key, totals, repaired = False, None, Totals(), Repaired()
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            r = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            if not began or r["conv_id"] != key:
                if began:
                    out.append({"conv_id": key} | totals.row() | repaired.end())
                began, key, totals, repaired = True, r["conv_id"], Totals(), Repaired()
            totals.add(r)
            repaired.take(r["symbols"], r["roles"], r["texts"], r["costs"])
        yield _record_batch(out, RESULT)
    if began:
        yield _record_batch([{"conv_id": key} | totals.row() | repaired.end()], RESULT)


def with_faults(messages: DataFrame) -> DataFrame:
    """Distinct messages (conv_id, turn, role, text) with copies, initial (0, 1, 2 for s, u, a, else 3) and the first fault of the first copy:
    blank, duplicate (role and text at an earlier turn; further copies are duplicates), truncated, or an empty string."""
    rows = messages.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.md5("text"))
    earlier = (F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("without"), F.count("*").alias("times"))
    repeats = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(*earlier).where("times > 1")
    rows = rows.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("without") | (F.col("turn") > F.col("first"))), F.lit(False))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "blank").when(seen, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.coalesce(*(F.when(F.col("role").startswith(c), F.lit(k)) for k, c in enumerate(INITIALS)), F.lit(3))
    return rows.select("conv_id", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"), "copies", "digest")


def repair_conversations(messages: DataFrame) -> DataFrame:
    """For messages (conv_id, turn, role, text), one row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Messages go by turn (nulls first), those of one turn by role and text (256 characters of it, then its digest; equal ones are copies side by
    side). Null roles and texts count as one space; messages without a conv_id are a conversation. A message is blank (no character
    but white space), else a duplicate (role and text seen earlier), else truncated (its last character is none of . ! ?). Edits: K keeps, R (1)
    makes it a user's or an assistant's, D (2) deletes, which blank and duplicate ones need, I (5) inserts an empty one; a truncated one that
    stays costs 5. Initials of roles must give (s?(ua)+)? in the end. The audit has the letters of the cheapest edits, of several the least
    in ASCII; the hash is of `role:text` of what is there then. illegal: neighbours other than su, ua, au before. gaps: whole turns that lack
    between the least and the greatest. No rows, no conversations. Other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    with scratch_tables(messages.sparkSession) as keep:
        order = ["conv_id", "turn", "role", F.left("text", F.lit(256)), "digest"]
        ordered = with_faults(rows).repartitionByRange(parallelism(messages.sparkSession), *order).sortWithinPartitions(*order)
        scanned = materialise(in_arrow(ordered.drop("digest"), scan_sorted, SCANNED_SQL), "segments")
        segments = scanned.where("k IS NOT NULL")
        backward = segments.select("conv_id", "part", "k", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("k"))
        costs = in_arrow(backward, costs_behind, "conv_id long, part long, k long, costs array<long>").select("part", "k", "costs")
        forward = segments.join(costs, ["part", "k"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
        parts = in_arrow(forward.select("conv_id", "symbols", "roles", "texts", "costs", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"), repair_segments, RESULT_SQL)
        return keep(materialise(scanned.where("k IS NULL").select(*RESULT.names).unionByName(parts), "repaired"))


def damage(messages: DataFrame) -> DataFrame:
    """The contract's damage by crc32(`conv_id:turn`) % 20: drop, empty, strip of . ! ?, repeat, make a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).where("h != 0")
    changed = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All damaged conversations repaired; those that lost every row too."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    repaired = repair_conversations(damage(conversations))
    out = every.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RESULT.names[1:7]]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
