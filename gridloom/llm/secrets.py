"""Secret scans of whole texts: three fixed patterns, and guess costs of values in credential contexts.

A value that stands behind a credential word is cut into words, dates, repeats,
keyboard walks and brute-force spans so that the guesses an attacker needs are
fewest; a dynamic programme over the value finds that cut. Every such value gets its
cost, one that a pattern has found too. Values that cost at least `least` (a power of
ten) are added as `guess` beside the patterns' spans, which stay as they are.

Words are ranked by how often the corpus has them, counted over all of it; the
`words` most frequent are the dictionary. A few fixed password words come first.

Defined cases: null text is empty and has no spans; a repeated row gets the same
result; words of equal counts go by their letters, and of two cuts of equal cost
only the cost is given; a very long value takes time in proportion to its length;
further columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns. Letters of the first are ASCII in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE = 8

# Context words, common password words by rank, and keyboard rows.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth|login|bearer)(?:[_-][a-z0-9]{1,32}){0,4}["']?(?:\s*(?:=>|:=|[:=])\s*|\x20+is\x20+)["']?([^\s"'<>]+)""",
    re.IGNORECASE | re.ASCII,
)
FIXED = (
    "password the qwerty admin welcome letmein monkey dragon master login princess sunshine shadow football baseball superman batman trustno iloveyou "
    "flower hello freedom whatever hunter ranger secret token key user root test guest default change changeme pass access temp love summer winter"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeolisst")

#: Lengths of dictionary words, and the most letters of a repeat's unit.
SHORTEST, LONGEST, UNIT = 3, 20, 8
#: Words of the dictionary.
WORDS = 30_000
#: Choosing where a span ends and what it is.
SPAN = math.log10(2 * LONGEST)
_DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d\d)|(?:19|20)\d\d[-/.]?\d{2}[-/.]?\d{2}|\d{6}")
_PLACE = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}


def ranked(words: Iterable[str]) -> dict[str, int]:
    """The rank of each word, the fixed ones first."""
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*FIXED, *words]))}


def dictionary(docs: DataFrame, words: int = WORDS) -> list[str]:
    """The corpus's most frequent words of ASCII letters, by count over all texts; ties go by letters."""
    other = "".join(c for c in map(chr, range(128)) if not c.isalpha())
    lowered = F.translate("text", string.ascii_uppercase + other, string.ascii_lowercase + " " * len(other))
    each = docs.select(F.explode(F.split(lowered, " ")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$"))
    return [r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(words).collect()]


def charset(c: str) -> int:
    if c.isascii():
        return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33
    return 1000


def beside(a: str, b: str) -> bool:
    p, q = _PLACE.get(a.lower()), _PLACE.get(b.lower())
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def word_cost(s: str, rank: dict[str, int]) -> float | None:
    low = s.lower()
    at, leet = rank.get(low), 0
    if at is None:
        at, leet = rank.get(low.translate(LEET)), 1
    if at is None:
        return None
    upper = sum(map(str.isupper, s))
    return math.log10(at) + (0 if not upper else math.log10(2) if s[0].isupper() and upper == 1 or upper == len(s) else upper * math.log10(2)) + leet * math.log10(4)


def spans(s: str, rank: dict[str, int], units: dict[str, float] | None = None) -> Iterator[tuple[int, int, float]]:
    """start, end and cost of every span but brute force, last starts first; their number is linear in the length of s.

    Repeats and keyboard walks are given at their full length from each start. A
    repeat costs what its unit costs, which is cut in the same way.
    """
    n, units = len(s), {} if units is None else units
    same, walk = dict.fromkeys(range(1, UNIT + 1), 0), 0
    for i in range(n - 1, -1, -1):
        walk = walk + 1 if i + 1 < n and beside(s[i], s[i + 1]) else 0
        for u in same:
            same[u] = same[u] + 1 if i + u < n and s[i] == s[i + u] else 0
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            if (cost := word_cost(s[i:j], rank)) is not None:
                yield i, j, cost
        if s[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(s, i, j):
                    yield i, j, math.log10(365 * 120) if j - i > 4 else math.log10(120)
        for u, run in same.items():
            if (times := run // u + 1) >= (3 if u == 1 else 2):
                unit = s[i : i + u]
                if unit not in units:
                    units[unit] = guess_cost(unit, rank, units)
                yield i, i + u * times, units[unit] + math.log10(times)
        if walk >= 2:
            yield i, i + walk + 1, math.log10(len(_PLACE)) + walk * math.log10(3)


def guess_cost(s: str, rank: dict[str, int], units: dict[str, float] | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation of s; units holds the costs of repeats' units that are known."""
    n = len(s)
    best, brute = [math.inf] * n + [0.0], math.inf  # brute: what s[i:] costs inside a brute-force span
    found, at = spans(s, rank, units), None
    for i in range(n - 1, -1, -1):
        brute = math.log10(charset(s[i])) + min(best[i + 1], brute)
        best[i] = SPAN + brute
        while (at := at or next(found, None)) and at[0] == i:
            best[i] = min(best[i], SPAN + at[2] + best[at[1]])
            at = None
    return best[0]


def find(text: str, least: float, cost_of: Callable[[str], float]) -> tuple[list[tuple[int, str, int]], list[float]]:
    """start, kind and end of all spans, by start and kind; and the costs of all values in credential contexts."""
    found: list[tuple[int, str, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    costs = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)")
        if len(value) < LEAST_VALUE:
            continue
        costs.append(cost_of(value))
        if costs[-1] >= least:
            found.append((m.start(1), "guess", m.start(1) + len(value)))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]))), costs


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, least: float = 10.0, words: int = WORDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_values, n_guess, min_cost and max_cost; texts aren't shuffled.

    n_values counts the values in credential contexts, and the costs are the least and the most of theirs.
    """
    told = docs.sparkSession.sparkContext.broadcast(ranked(dictionary(docs, words)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost_of = partial(guess_cost, rank=told.value)
        for b in it:
            rows = []
            for t in b.column("text"):
                found, costs = find(t.as_py() or "", least, cost_of)
                base = [x for x in found if x[1] != "guess"]
                n = [sum(x[1] == k for x in found) for k in KINDS]
                rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(costs), n[3], min(costs, default=None), max(costs, default=None)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()] * 2
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    names = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType(), "n_values": T.LongType(), "n_guess": T.LongType(), "min_cost": T.DoubleType(), "max_cost": T.DoubleType()}
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in names.items())]))
