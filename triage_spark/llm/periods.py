"""Periodic runs of words: dyadic blocks look up their next and last occurrences in a wavelet tree over the suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPONENT = 4  # periods that a run holds at least
SHORTEST = 6  # words that a run has at least
BATCH = 1 << 17  # words that are sorted together


class Wavelet:
    """A wavelet matrix over whole numbers: counts and order statistics of any range, all queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = int(values.max(initial=0)).bit_length() or 1
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than x."""
        count = np.zeros(len(x), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros):
            one, a, b = (x >> bit & 1).astype(bool), zeros[lo], zeros[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th least value of [lo, hi), from 0."""
        value = np.zeros(len(n), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros):
            a, b = zeros[lo], zeros[hi]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value


def suffixes_and_blocks(word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Suffix array, text by text, and for each power of two the aligned blocks that occur again in their text.

    word: codes that differ between texts; begin, end: of the text of each word. Blocks come as (place, first and past-the-last
    index of their interval in the suffix array, length), from two words on, taken while prefix doubling
    passes that length.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    sorted_words = word[order]
    head = np.flatnonzero(np.diff(sorted_words, prepend=-1) != 0)
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, sizes)
    suffixes = order.copy()
    active = order[np.repeat(sizes > 1, sizes)]
    blocks, width = [], 1
    while len(active):
        ahead = active + width
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        key = rank[active] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        at = np.arange(len(active))
        first_old = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, at, 0))
        suffixes[old + at - first_old] = active
        new = np.diff(key, prepend=-1) != 0
        first_new = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + first_new - first_old
        sizes = np.diff(np.append(np.flatnonzero(new), len(active)))
        size = np.repeat(sizes, sizes)
        active, size = active[size > 1], size[size > 1]
        width *= 2
        block = ((active - begin[active]) % width == 0) & (active + width <= end[active])
        place = active[block]
        blocks.append((place, rank[place], rank[place] + size[block], np.full(len(place), width)))
    return suffixes, blocks


def candidates(word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of stretches of at least two periods that hold all runs of EXPONENT periods.

    A run of four periods q or more holds an aligned block of at least q and less than 2q words whose next occurrence, or
    else its last one, is q words off and in the run, so in the window of the block's own length beside it. A block that
    is not shorter than its step to the neighbour repeats with that step: occurrences in the window are a progression, and the
    nearest one has its difference. The tree is built over the intervals that blocks use.
    """
    suffixes, blocks = suffixes_and_blocks(word, begin, end)
    place, lo, hi, width = (np.concatenate(x) if blocks else np.zeros(0, np.int64) for x in (zip(*blocks) if blocks else [[]] * 4))
    if not len(place):
        return place, place
    used = np.zeros(len(word) + 1, np.int64)
    np.add.at(used, lo, 1)
    np.add.at(used, hi, -1)
    used = np.cumsum(used[:-1]) > 0
    index = np.concatenate([[0], np.cumsum(used)])
    tree = Wavelet(suffixes[used] - begin[suffixes[used]])
    lo, hi, local = index[lo], index[hi], place - begin[place]
    at = tree.below(lo, hi, local)
    out = []
    for step in (1, -1):
        k = np.flatnonzero((at + step >= 0) & (at + step < hi - lo))
        other = tree.nth(lo[k], hi[k], at[k] + step)
        period = np.abs(other - local[k])
        near = period <= width[k]
        out.append((begin[place[k]][near] + np.minimum(other, local[k])[near], period[near]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def runs_of(word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By the first word of a text its runs (start, length, period), by start, then period."""
    place, period = candidates(word, begin, end)
    found: dict[int, list[tuple[int, int, int]]] = {}
    if not len(place):
        return found
    base = begin[place]
    order = np.lexsort((place, period, base))
    place, period, base = place[order], period[order], base[order]
    heads = np.flatnonzero((np.diff(base, prepend=-1) != 0) | (np.diff(period, prepend=-1) != 0))
    for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(place)]):
        b, q = int(base[a]), int(period[a])
        e = int(end[b])
        least = max(SHORTEST, EXPONENT * q) - q
        if e - b < least + q:
            continue
        equal = np.zeros(e - b - q + 2, np.int8)
        equal[1:-1] = word[b : e - q] == word[b + q : e]
        edge = np.flatnonzero(np.diff(equal))  # maximal stretches of words that are repeated q words later
        k = np.unique(np.searchsorted(edge[::2], place[a:z] - b, "right") - 1)
        for start, stop in zip(edge[::2][k].tolist(), edge[1::2][k].tolist()):
            if stop - start >= least:
                found.setdefault(b, []).append((start, stop - start + q, q))
    for runs in found.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_words, runs (start, length, period in words) and collapsed of each text.

    Words are what white space of ASCII parts. A run is a stretch with the smallest period q, of at least SHORTEST words and
    EXPONENT * q, that cannot be extended; collapsed has each run's first q words and all words outside runs, joined by
    one space. Every text is taken whole and on its own, in batches of BATCH words; a longer one is a batch, and needs some 200
    bytes a word. No shuffle. Null, empty and blank texts have no words and an empty collapsed text; rows stay one
    by one, with null or repeated keys too; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, size = 0, [], 0
            for k, t in enumerate(b.column(1)):
                body = t.as_buffer()
                held.append(body.to_pybytes().split() if body is not None else [])
                size += len(held[-1])
                if size >= BATCH or k == b.num_rows - 1:
                    runs, collapsed = collapse(held)
                    yield pa.RecordBatch.from_arrays([b.column(0)[at : k + 1], pa.array(map(len, held), pa.int64()), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])
                    at, held, size = k + 1, [], 0

    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "period")]
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType(longs))), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(key), F.col(text).alias("text__" if key == text else text)).mapInArrow(find, schema)


def collapse(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs of each text and its words without the later periods."""
    codes, base = [], 0
    for words in texts:
        known = dict.fromkeys(words)
        known.update(zip(known, range(base, base + len(known))))
        codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        base += len(known)
    sizes = np.array([len(c) for c in codes])
    first = np.cumsum(sizes) - sizes
    found = runs_of(np.concatenate(codes), np.repeat(first, sizes), np.repeat(first + sizes, sizes)) if sizes.sum() else {}
    all_runs, out = [], []
    for words, b in zip(texts, first.tolist()):
        runs = found.get(b, []) if words else []
        if runs:
            gone = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                gone[start + period] += 1
                gone[start + length] -= 1
            words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
        out.append(b" ".join(words))
    return all_runs, out
