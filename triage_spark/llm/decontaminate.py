"""Benchmark items inside training texts: BM25 retrieval with block-max WAND, then overlap checks."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage_spark.llm.common import trim

WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK = 32  # postings of a block
NON_ESSENTIAL = 0.3  # share of an item's score that its non-essential terms may hold; under the threshold
INDEX_BYTES = 64 << 20  # texts of one broadcast index


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item's question and answer: its last sentence is the answer, or the last quarter of one sentence."""
    parts = [w for s in SENTENCE_END.split(text) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share(part: set, passage: list[str], cache: dict[int, set]) -> float:
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n not in cache:
        cache[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(part & cache[n]) / len(part)


class BlockMaxIndex:
    """Inverted index of items whose BM25 impacts are divided by the item's score for its own text."""

    def __init__(self, items: list[tuple], df: dict[str, int], n_items: int, mean_words: float, least: float = 2 * NON_ESSENTIAL):
        self.ids, self.parts, self.term = [], [], {}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.longest = 1
        for k, (item, text) in enumerate(sorted(items, key=lambda x: str(x[0]))):
            words = words_of(text)
            q, a = question_answer(text)
            self.ids.append(item)
            self.parts.append((shingles(words), shingles(q), shingles(a)))
            self.longest = max(self.longest, len(words))
            own = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean_words)) for w, c in Counter(words).items()}
            total = sum(own.values())
            for w, v in own.items():
                postings[self.term.setdefault(w, len(self.term))].append((k, v / total))
        n = len(self.term)
        self.docs = [np.array([d for d, _ in postings[t]]) for t in range(n)]
        self.impacts = [np.array([v for _, v in postings[t]]) for t in range(n)]
        self.block_max = [np.maximum.reduceat(v, np.arange(0, len(v), BLOCK)) for v in self.impacts]
        self.block_end = [np.array([d[min(i + BLOCK, len(d)) - 1] for i in range(0, len(d), BLOCK)]) for d in self.docs]
        self.most = np.array([v.max() for v in self.impacts]) if n else np.zeros(1)
        # non-essential terms, the most frequent ones: all of an item's together stay under half of `least`, the lowest
        # threshold that will be asked for, so that no item can reach it by them alone
        allowed = min(NON_ESSENTIAL, least / 2)
        self.slack, self.essential = np.zeros(len(self.ids)), np.ones(max(n, 1), dtype=bool)
        for t in sorted(range(n), key=lambda t: -len(self.docs[t])):
            if len(self.docs[t]) == 1 or (self.slack[self.docs[t]] + self.impacts[t]).max() > allowed:
                break
            self.slack[self.docs[t]] += self.impacts[t]
            self.essential[t] = False
        self.first = np.cumsum([0, *map(len, self.docs)])
        self.all_docs = np.concatenate(self.docs) if n else np.zeros(0, dtype=np.int64)
        self.all_impacts = np.concatenate(self.impacts) if n else np.zeros(0)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items with score >= threshold for the query terms: block-max WAND, no limit on their number."""
        at = {t: 0 for t in terms}
        out = []
        eps = threshold - 1e-9
        while at:
            order = sorted(at, key=lambda t: self.docs[t][at[t]])
            bound, pivot = 0.0, None
            for p, t in enumerate(order):
                bound += self.most[t]
                if bound >= eps:
                    pivot = p
                    break
            if pivot is None:
                break
            d = int(self.docs[order[pivot]][at[order[pivot]]])
            while pivot + 1 < len(order) and self.docs[order[pivot + 1]][at[order[pivot + 1]]] == d:
                pivot += 1
            near, blocks = order[: pivot + 1], {}
            for t in near:  # the block that would hold item d, without reading its postings
                blocks[t] = int(np.searchsorted(self.block_end[t], d))
            limit = sum(self.block_max[t][b] for t, b in blocks.items() if b < len(self.block_max[t]))
            if limit >= eps:
                score = 0.0
                for t in near:
                    i = int(np.searchsorted(self.docs[t], d))
                    if i < len(self.docs[t]) and self.docs[t][i] == d:
                        score += self.impacts[t][i]
                if score >= eps:
                    out.append((d, score))
                target = d + 1
            else:  # no item before the nearest block end can reach the threshold
                ends = [int(self.block_end[t][b]) for t, b in blocks.items() if b < len(self.block_end[t])]
                target = min(ends, default=d) + 1
                if pivot + 1 < len(order):
                    target = min(target, int(self.docs[order[pivot + 1]][at[order[pivot + 1]]]))
                target = max(target, d + 1)
            for t in near:
                i = int(np.searchsorted(self.docs[t], target))
                if i < len(self.docs[t]):
                    at[t] = i
                else:
                    del at[t]
        return out

    def promising(self, passages: np.ndarray, terms: np.ndarray, threshold: float) -> np.ndarray:
        """Passages for which some item's essential terms, with all its others added, reach the threshold."""
        keep = self.essential[terms]
        passages, terms = passages[keep], terms[keep]
        n = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, inverse = np.unique(np.repeat(passages, n) * len(self.ids) + self.all_docs[at], return_inverse=True)
        bound = np.bincount(inverse, weights=self.all_impacts[at], minlength=len(pairs)) + self.slack[pairs % len(self.ids)]
        return np.unique(pairs[bound >= threshold - 1e-9] // len(self.ids))

    def matches(self, text: str | None, threshold: float, overlap: float, part_overlap: float) -> list[tuple]:
        """(item, score, whole, question, answer, first word) of each item found, at its best passage."""
        words = words_of(text or "")
        if not words or not self.ids:
            return []
        stride = self.longest
        ids = np.fromiter(map(self.term.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        places = np.flatnonzero(ids >= 0)
        if not len(places):
            return []
        known, w, v = ids[places], places // stride, len(self.term)
        # passages of two strides, one stride apart: every run of up to `stride` words lies in one of them
        keys = np.unique(np.concatenate([w * v + known, np.maximum(w - 1, 0) * v + known]))
        best: dict[int, tuple] = {}
        for p in self.promising(keys // v, keys % v, threshold):
            lo, hi = np.searchsorted(keys, [p * v, (p + 1) * v])
            found = self.search((keys[lo:hi] % v).tolist(), threshold)
            if found:
                passage, cache = words[p * stride : (p + 2) * stride], {}
                for k, score in found:
                    whole, q, a = (share(x, passage, cache) for x in self.parts[k])
                    if whole >= overlap and q >= part_overlap and a >= part_overlap:
                        best[k] = max(best.get(k, (0,)), (whole, float(score), q, a, -int(p) * stride))
        return [(self.ids[k], s, whole, q, a, -at) for k, (whole, s, q, a, at) in sorted(best.items())]


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", max_bytes: int = INDEX_BYTES, least: float = 2 * NON_ESSENTIAL) -> Iterator[BlockMaxIndex]:
    """One index while the items' texts stay under max_bytes; beyond it one per block of items of that size.

    Document frequencies cover all items. Null and wordless items are left out: they can overlap nothing.
    """
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).dropna(subset=["text"])
    words = rows.select("item", F.expr(r"regexp_extract_all(lower(text), '(?U)\\w+', 0)").alias("words")).filter("size(words) > 0")
    n, mean, size = words.join(rows.select("item", F.octet_length("text").alias("b")), "item").agg(F.count("*"), F.avg(F.size("words")), F.sum("b")).first()
    if not n:
        return
    df = words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    blocks = max(1, -(-int(size) // max_bytes))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        own = [tuple(r) for r in part.collect() if words_of(r["text"])]
        vocabulary = part.select(F.explode(F.expr(r"array_distinct(regexp_extract_all(lower(text), '(?U)\\w+', 0))")).alias("word")).distinct()
        known = {r["word"]: r["df"] for r in df.join(vocabulary, "word").collect()}
        freq = defaultdict(lambda: 1, known)
        yield BlockMaxIndex(own, {w: freq[w] for _, t in own for w in words_of(t)}, n, mean, least)


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_overlap: float = 0.5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", max_bytes: int = INDEX_BYTES
) -> DataFrame:
    """One row per document and benchmark item that a passage of it repeats.

    Every passage (two strides of the longest item, a stride apart) of every whole text is a query; all
    items with at least `threshold` of their own BM25 score come back. A match must hold `overlap` of the
    item's distinct five-word shingles and `part_overlap` of those of its question and of its answer (a part
    of fewer words counts as one). Null texts and an empty benchmark give no rows, repeated documents one each. Long
    texts are many passages; of passages that tie for an item the first is named; only key and text are read.

    Returns key, item_key, bm25 (share of the item's own score), overlap, question_overlap,
    answer_overlap, passage_word (where the passage begins). Nothing is shuffled.
    """
    if key == item_key or not 0 < threshold <= 1:
        raise ValueError("the two keys need different names, and the threshold is over 0 and at most 1")
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    doubles = ("bm25", "overlap", "question_overlap", "answer_overlap")
    schema = T.StructType([T.StructField(key, kind), T.StructField(item_key, item_kind), *(T.StructField(c, T.DoubleType()) for c in doubles), T.StructField("passage_word", T.LongType())])
    rows, out = docs.select(key, text), None
    for index in indexes(items, item_key, max_bytes=max_bytes, least=threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(k, *m) for k, t in zip(b[key], b[text]) for m in shared.value.matches(t, threshold, overlap, part_overlap)]
                if found:
                    yield pd.DataFrame(found, columns=schema.names)
            trim()

        part = rows.mapInPandas(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
