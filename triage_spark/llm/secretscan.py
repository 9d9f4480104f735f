"""Secrets in whole texts: fixed patterns, and credential values judged by their guess cost."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import stored

# The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
HINTS = ("pass", "secret", "token", "api", "pwd", "credential", "private", "auth")  # each match of ASSIGN or CONTEXT holds one

# Values that stand in a credential's context: what the method looks at.
CONTEXT = re.compile(r"""(?ai:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|credentials?|private_?key|auth)["']?(?:\s*[:=]\s*|\s+is\s+)["']?([^\s"'<>,;]{6,})""")

# Common words of passwords, the most common first.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess football shadow sunshine "
    "superman batman trustno1 secret token hello freedom whatever love test guest root user changeme default "
    "summer winter spring autumn january february march april may june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday example sample dummy placeholder"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("013457@$!", "oieastasi")
DATES = [
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
]
NEXT_TO = {pair for row in ROWS for a, b in zip(row, row[1:]) for pair in ((a, b), (b, a))} | {pair for r, s in zip(ROWS, ROWS[1:]) for a, b in zip(r, s) for pair in ((a, b), (b, a))}


# Words learned from the documents.
WORD = re.compile(r"[^\W\d_]{3,}")
LETTERS, MOST_WORDS, LEAST_DOCS = 32, 1 << 17, 2  # longest word, words that are sent to the executors, documents a word stands in


class Ranks(dict):
    """Words with their ranks, the most common first, and the length of the longest."""

    def __init__(self, ranks=()):
        super().__init__(ranks)
        self.longest = max(map(len, self), default=0)


COMMON_RANKS = Ranks({w: k + 1 for k, w in enumerate(COMMON)})


def alphabet(text: str) -> int:
    """Characters a brute-force guess must try: digits, lower, upper and other ones that occur."""
    classes = ((10, str.isdigit), (26, str.islower), (26, str.isupper))
    n = sum(size for size, test in classes if any(map(test, text)))
    return n + 33 * any(not c.isalnum() for c in text) or 10


class Run:
    """The cheapest last span at each place that lies in a run: of one unit repeated, or of neighbouring keys.

    A span (i, j) costs fixed + log10(j - i) on top of best[i]. What a start loses to an earlier one only grows
    with j, so a start that an earlier one has beaten is dropped for good, and so is an earlier one that is not
    cheaper by itself: few starts are held however long the run is.
    """

    def __init__(self, unit: int, least: int, fixed: float, kind: str):
        self.unit, self.least, self.fixed, self.kind = unit, least, fixed, kind
        self.begin, self.held = 0, [[] for _ in range(unit)]

    def reach(self, j: int, goes_on: bool, best: list[tuple[float, int, str]]) -> list[tuple[float, int, str]]:
        if not goes_on:
            self.begin, self.held = max(0, j - self.unit), [[] for _ in range(self.unit)]
            return []
        held = self.held[j % self.unit]
        if (i := j - self.least) >= self.begin:
            held.append((best[i][0] + (0.3 if i else 0.0), i))
        if not held:
            return []
        cost, at = min((own + math.log10(j - i), k) for k, (own, i) in enumerate(held))
        held[:] = [h for h in held[:at] if h[0] < held[at][0]] + [held[at]]
        return [(cost + self.fixed, held[-1][1], self.kind)]


def guess_cost(value: str, words: dict[str, int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for a value, and its cheapest segmentation as (kind, start, end).

    best[j] is the least cost of value[:j] over all last spans: a listed word (rank, times 2 for capitals or
    look-alike digits), a date, a repeat, a keyboard walk, or a brute-force span (alphabet ** length). Each
    span costs one factor more, for where it begins.
    """
    words = words if isinstance(words, Ranks) else Ranks(words or COMMON_RANKS)
    n, low = len(value), value.lower()
    longest, plain = words.longest, low.translate(LEET)
    size = math.log10(alphabet(value))
    spans: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for date in DATES if value[i].isdigit() else ():
            if m := date.match(value, i):
                spans[m.end()].append((i, math.log10(365 * 120 if m.end() - i > 4 else 120), "date"))
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = words.get(low[i:j]) or words.get(plain[i:j])
            if rank:
                varied = 2 if value[i:j] != low[i:j] or plain[i:j] != low[i:j] else 1
                spans[j].append((i, math.log10(rank * varied + 1), "word"))
    runs = [Run(1, 3, math.log10(len(ROWS) * 10 * 2), "walk")]
    runs += [Run(unit, 3 if unit == 1 else 2 * unit, unit * size - math.log10(unit), "repeat") for unit in (1, 2, 3, 4)]
    best, start = [(0.0, 0, "")], (math.inf, 0)
    for j in range(1, n + 1):
        options = [(best[i][0] + cost + (0.3 if i else 0.0), i, kind) for i, cost, kind in spans[j]]
        for run in runs:
            goes_on = j > run.unit and value[j - 1] == value[j - 1 - run.unit] if run.kind == "repeat" else j > 1 and (low[j - 2], low[j - 1]) in NEXT_TO
            options += run.reach(j, goes_on, best)
        i = j - 1
        start = min(start, (best[i][0] - i * size + (0.3 if i else 0.0), i))  # the best one of a brute-force span
        options.append((start[0] + j * size, start[1], "brute"))
        best.append(min(options))
    out, j = [], n
    while j:
        out.append((best[j][2], best[j][1], j))
        j = best[j][1]
    return best[n][0], out[::-1]


def find_spans(text: str, least_cost: float = 8.0, words: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    out = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        out += [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], words)[0] >= least_cost]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def learned_words(docs: DataFrame, text: str = "text") -> Ranks:
    """COMMON and the words that stand in the most documents (LEAST_DOCS at least), by rank.

    All words down to the number of documents at which no more than MOST_WORDS are reached.

    Values in a credential's context do not count, so that no secret becomes a word of its own. Only the words
    that are kept reach the driver: a few MB at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter()
            for t in b.column(0).to_pylist():
                low = t.lower()
                if any(h in low for h in HINTS):
                    low = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], t).lower()
                n.update({w for w in WORD.findall(low) if len(w) <= LETTERS})
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "docs"])

    counts = docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs"))
    counts = stored(counts.filter(F.col("docs") >= LEAST_DOCS))
    # the lowest number of documents that fits, from one row per number: a sort with a limit would send one list per task
    kept, least = 0, None
    for r in sorted(counts.groupBy("docs").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["docs"]):
        kept += r["words"]
        if kept > MOST_WORDS:
            break
        least = r["docs"]
    top = sorted(counts.filter(F.col("docs") >= least).collect(), key=lambda r: (-r["docs"], r["word"])) if least is not None else []
    ranks = {r["word"]: k + 1 for k, r in enumerate(top)}
    return Ranks(ranks | {w: min(k, ranks.get(w, k)) for w, k in COMMON_RANKS.items()})


def scan(docs: DataFrame, least_cost: float = 8.0, text: str = "text") -> DataFrame:
    """Add `secrets`: array<struct<kind, start, end>> for each whole text (null: empty), in text order.

    Base kinds: assign, access, hex. The method adds 'guess': a value in a credential's context whose
    cheapest segmentation still costs 10^least_cost guesses; placeholders and walks like 'password123' stay
    out, and so do values of ordinary words, which are learned from all rows. Repeated rows get equal answers, an existing column `secrets` is replaced.
    """

    words = docs.sparkSession.sparkContext.broadcast(learned_words(docs, text))

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t or "", least_cost, words.value)] for t in s], index=s.index, dtype=object)

    return docs.withColumn("secrets", find(F.coalesce(F.col(text), F.lit(""))))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """sha256 of the base spans, as the query returns it (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "guess").encode()).hexdigest()
