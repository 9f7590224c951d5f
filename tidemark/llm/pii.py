"""Personal data in texts by weak supervision.

Spans of the base patterns always count. Beside them stand candidates that the base patterns miss: parts of a dropped
match that are sound by themselves, addresses written around their signs, numbers in national form. Five labelers
(pattern, check digits or form, gazetteer, context, borders) vote for, against or not at all on each base span
and candidate. How often each combination of votes and shape occurs, which is a small table however many documents
there are, is all that training needs: expectation-maximisation estimates from it how reliable each labeler is for
each kind, and a logistic regression on votes and shape learns from the resulting probabilities. It decides on candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, in_arrow, materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MARKS = tuple(f"[{k.upper()}]" for k in KINDS)
#: A candidate counts from this probability on.
SURE = 0.8
#: Characters before a span that the context labeler reads.
NEAR = 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No part of these patterns can match what the next part needs, so none has to give back what it took.
IP_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ROUND = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)
NATIONAL = re.compile(r"(?<![\w+.\-])(?:\([0-9]{2,4}\)|[0-9]{3,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w\-])")
GROUPED = re.compile(r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{2,4}\))?(?:[ .-][0-9]{2,4}){2,4}(?![0-9])")
LONG_NUMBER = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
DIGIT = re.compile("[0-9]")

# Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov int info biz io de fr es it nl uk us ca eu ch at be pl se no dk fi pt ie au jp cn in br ru mx".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "351", "353", "358", "380", "420")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "60", "62", "64", "65", "35", "50", "56", "57", "58")
FOR = (
    frozenset("email e-mail mail contact write kontakt correo courriel".split()),
    frozenset("ip address host server client from login adresse".split()),
    frozenset("card visa mastercard credit debit payment karte carte tarjeta paid".split()),
    frozenset("phone tel call mobile fax cell telefon telephone telefono ring whatsapp".split()),
)
AGAINST = frozenset("version release isbn issn sha hash token id serial order article section doi ref build v".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern with + and @ finds them, but in time that follows the text: it goes from sign to sign."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        else:
            free = max(free, at)  # a later one cannot start before this sign
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base patterns, in order of kind and start, and of the matches that their checks drop."""
    kept, dropped = [(EMAIL, a, b) for a, b in emails(text)], []
    if DIGIT.search(text):
        for m in IP_RUN.finditer(text):
            (kept if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")) else dropped).append((IP, *m.span()))
        for m in CARD_RUN.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            (kept if 13 <= len(d) <= 19 and luhn(d) else dropped).append((CARD, *m.span()))
        for m in PHONE_RUN.finditer(text):
            (kept if 9 <= len(digits_of(m[0])) <= 15 else dropped).append((PHONE, *m.span()))
    return kept, dropped


def candidates(text: str, kept: list[tuple[int, int, int]], dropped: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, source) of what the base patterns miss; none overlaps a base span."""
    found: list[tuple[int, int, int, int]] = []
    for kind, a, b in dropped:
        if kind == CARD and b - a > 13:
            found += [(CARD, a + m.start(), a + m.end(), 1) for m in LONG_NUMBER.finditer(text[a:b]) if luhn(m[0])]
        elif kind == PHONE and (m := GROUPED.match(text, a, b)) and 9 <= len(digits_of(m[0])) <= 15:
            found.append((PHONE, *m.span(), 1))
    lower = text.lower() if "(" in text or "[" in text else ""
    if "(at)" in lower or "[at]" in lower:
        found += [(EMAIL, *m.span(), 2) for m in ROUND.finditer(text)]
    if DIGIT.search(text):
        found += [(PHONE, *m.span(), 2) for m in NATIONAL.finditer(text) if 9 <= len(digits_of(m[0])) <= 12]
    if not found:
        return []
    taken, out = sorted((a, b) for _, a, b in kept), []
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts  # the last end of spans up to each
    last = -1
    for kind, a, b, source in sorted(found, key=lambda x: (x[1], x[0], -x[2])):
        k = int(np.searchsorted(starts, b)) if taken else 0
        if a >= last and not (k and ends[k - 1] > a):
            out.append((kind, a, b, source))
            last = b
    return out


def votes(text: str, kind: int, a: int, b: int, source: int) -> tuple[int, ...]:
    """-1, 0 or 1 from each labeler: pattern, form, gazetteer, context, borders."""
    s, d = text[a:b], digits_of(text[a:b])
    pattern = 1 if source == 0 else 0 if source == 1 else -1 if kind == PHONE else 0
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", s.rstrip("])"))[-1].lower()
        form = 1 if last.isalpha() and len(last) >= 2 else -1
        gazetteer = 1 if last in TOP_DOMAINS else 0
    elif kind == IP:
        parts = s.split(".")
        form = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = -1 if parts[0] in ("0", "127") or len(set(parts)) == 1 else 1
    elif kind == CARD:
        form = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        gazetteer = 1 if d.startswith(CARD_PREFIXES) and len(set(d)) > 2 else -1
    else:
        form = 1 if source < 2 and 9 <= len(d) <= 15 else 0
        gazetteer = (1 if d.startswith(CALLING_CODES) else -1) if s[0] == "+" else 0
    near = {w.lower() for w in WORD.findall(text[max(0, a - NEAR) : a])[-4:]}
    context = 1 if near & FOR[kind] else -1 if near & AGAINST else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    borders = -1 if left.isalnum() or right.isalnum() or left in ("=", "_") and left else 1
    return pattern, form, gazetteer, context, borders


def code_of(kind: int, source: int, v: tuple[int, ...], digits: int) -> int:
    """Kind, source, votes and a digit class (of 5) as one number below 4 * 3 * 243 * 5."""
    code = kind * 3 + source
    for x in v:
        code = code * 3 + x + 1
    return code * 5 + min(4, digits // 4)


def uncode(code: int) -> tuple[int, int, tuple[int, ...], int]:
    code, digits = divmod(code, 5)
    v = []
    for _ in range(5):
        code, x = divmod(code, 3)
        v.append(x - 1)
    return *divmod(code, 3), tuple(v[::-1]), digits


def scan(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of base spans (source 0 in the code) and candidates."""
    kept, dropped = base_spans(text)
    every = [(k, a, b, 0) for k, a, b in kept] + candidates(text, kept, dropped)
    return sorted((k, a, b, code_of(k, source, votes(text, k, a, b, source), len(digits_of(text[a:b])))) for k, a, b, source in every)


SOURCE = 5 * 3**5  # code // SOURCE % 3 is the source


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, code) of each row of docs (doc_id, text), as a shared-folder table."""
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[dict(zip(("kind", "start", "end", "code"), x)) for x in scan(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, spans)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialise(in_arrow(rows, run, "doc_id long, spans array<struct<kind:int,start:long,end:long,code:int>>"), "spans")


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability that each combination of votes (rows of -1, 0, 1) marks personal data, by expectation-maximisation over
    their counts n. Labelers start out as rather right, by a fixed number of assumed cases."""
    assumed = 20 * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])  # votes against, none, for: of no data, of data
    p = 1 / (1 + np.exp(-1.5 * v @ np.array([1.0, 1.5, 0.5, 1.0, 0.7])))
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        share = (w.sum(1) + 1) / (n.sum() + 2)
        log = np.log(share)[:, None] + np.zeros((2, len(n)))
        for j in range(v.shape[1]):
            seen = np.stack([[w[z, v[:, j] == x].sum() for x in (-1, 0, 1)] for z in (0, 1)]) + assumed
            log += np.log(seen / seen.sum(1, keepdims=True))[:, v[:, j] + 1]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p


def features(codes: list[int]) -> np.ndarray:
    rows = []
    for code in codes:
        kind, source, v, digits = uncode(code)
        rows.append([1.0, *(kind == k for k in range(3)), *(x == 1 for x in v), *(x == -1 for x in v), *(digits == k for k in range(1, 5)), source == 1, source == 2])
    return np.array(rows, float)


def train(counts: dict[int, int]) -> dict[int, float]:
    """Probability by the span classifier for each code, from how often each occurs."""
    if not counts:
        return {}
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kinds = np.array([uncode(c)[0] for c in codes])
    v = np.array([uncode(c)[2] for c in codes])
    soft = np.zeros(len(codes))
    for k in set(kinds.tolist()):
        soft[kinds == k] = reliabilities(v[kinds == k], n[kinds == k])
    x, w = features(codes), np.sqrt(n)  # damped, so that a common shape does not drown the rest
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta)), x.T @ (w * (soft - p)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist()))


def accepted_codes(scanned: DataFrame, sure: float = SURE) -> list[int]:
    """The codes whose candidates count, learnt from all spans of a scan_documents table."""
    counts = scanned.select(F.explode("spans.code").alias("code")).groupBy("code").count()
    model = train({r["code"]: r["count"] for r in counts.collect()})  # 14,580 codes at most
    return sorted(c for c, p in model.items() if c // SOURCE % 3 and p >= sure)


def _is_base(s: Column) -> Column:
    return (s["code"] / SOURCE).cast("int") % 3 == 0


def find_pii(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, code) of each row of docs (doc_id, text), base ones and added
    ones, in order of kind and start. Null and empty texts have none; other columns are not read."""
    scanned = scan_documents(docs)
    accepted = accepted_codes(scanned, sure)
    counts = lambda s: _is_base(s) | s["code"].isin(accepted) if accepted else _is_base(s)
    return scanned.select("doc_id", F.filter("spans", counts).alias("spans"))


def redact_text(text: str, accepted: frozenset[int]) -> str:
    """text with a mark in place of each span; of overlapping spans the first and longest gives the mark for all."""
    spans = sorted(((a, -b, k) for k, a, b, code in scan(text) if not code // SOURCE % 3 or code in accepted))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], MARKS[k]]
        at = max(at, -b)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """docs with each span of personal data in text replaced by a mark such as [EMAIL]; all other columns and rows stay."""
    keep = frozenset(accepted_codes(scan_documents(docs), sure))

    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([redact_text(t.as_py(), keep) if t.is_valid else None for t in texts], pa.string())

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of base spans, and all spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", _is_base)
    number = lambda k: F.size(F.filter("spans", lambda s: _is_base(s) & (s["kind"] == k))).cast("long")
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
