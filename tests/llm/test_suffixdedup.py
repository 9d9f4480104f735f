"""Repeated strings beside a brute-force count of all strings of 200 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from triage_spark.llm import queries, suffixdedup

SF = "/root/testdata/sf0.001"


def brute(texts, length=200):
    """For each text its spans of bytes in strings that begin elsewhere too."""
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        inside = np.concatenate([[0], (np.cumsum(gone)[:-1] > 0).astype(int), [0]])
        out.append([int(x) for x in np.flatnonzero(np.diff(inside))])
    return out


def planted(seed):
    """Texts that share passages of 150 to 900 bytes, edited copies, exact copies, periodic stretches and others."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(rng.randint(25, 160)) for _ in range(6)]
    base = prose(300)
    texts = [prose(rng.randint(0, 120)) + rng.choice(shared) + prose(rng.randint(0, 60)) + rng.choice(shared) for _ in range(40)]
    for _ in range(40):  # copies with up to three edits
        t = base
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "X", "yy zz"]) + t[k + 1 :]
        texts.append(t)
    texts += ["a" * 450, "b" * 200, "c" * 201, "ab" * 180 + prose(10), "xyz " * 120, base[:199], base[50:250], base[50:249], "", "k" * 7]
    return texts


def test_op11_on_the_table(spark):
    rows = {r["doc_id"]: r for r in queries.op11_repeated_strings(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in docs]
    assert len(rows) == len(docs)
    for r, t, spans in zip(docs, texts, brute(texts)):
        got = rows[r["doc_id"]]
        kept = b"".join(t[a:z] for a, z in zip([0, *spans[1::2]], [*spans[::2], len(t)]))
        assert (got["n_bytes"], got["n_removed"], got["n_spans"], got["kept_sha256"]) == (len(t), len(t) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("widest, chunk, block", [(4096, 1 << 20, 2 << 20), (2, 700, 1000), (0, 1 << 20, 1)])
def test_op11_on_planted_texts(spark, monkeypatch, widest, chunk, block):
    """With few classes a bucket, texts in parts and blocks of one bucket as with the usual sizes."""
    texts = planted(widest)
    monkeypatch.setattr(suffixdedup, "WIDEST", widest)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
    monkeypatch.setattr(suffixdedup, "BLOCK", block)
    got = {r["doc_id"]: list(r["spans"]) for r in suffixdedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))


def test_contexts_of_parts_are_those_of_the_whole():
    data = " ".join(planted(3)[:30]).encode()
    whole = suffixdedup.contexts(np.frombuffer(data, np.uint8), np.array([len(data)]), 200)
    starts = lambda c: {k for f, e in zip(c[2].tolist(), c[3].tolist()) for k in range(f, e + 1)}
    assert starts(whole) == set(range(len(data) - 199))
    assert all(f <= p <= e + 200 - suffixdedup.GRAM for f, e, p in zip(*(c.tolist() for c in whole[2:])))


def test_sorted_suffixes_find_twins():
    """Two contexts that agree in part: exactly the shared strings are twins."""
    rng = np.random.default_rng(1)
    gram = bytes(rng.integers(97, 123, 32, dtype=np.uint8))
    left, right = bytes(rng.integers(97, 123, 168, dtype=np.uint8)), bytes(rng.integers(97, 123, 168, dtype=np.uint8))
    for a in (0, 5, 64, 100, 168):
        for b in (0, 7, 90, 168):
            one, two = left + gram + right, b"#" * (168 - a) + left[168 - a :] + gram + right[:b] + b"#" * (168 - b)
            segment, distance, twin = suffixdedup.sort_suffixes([one, two], np.array([168, 168]), np.array([169, 169]), 200)
            want = {d for d in range(169) if d <= a and 200 - 32 - d <= b}
            assert {d for d, t in zip(distance.tolist(), twin.tolist()) if t} == want


def test_op11_odd_input(spark):
    long = " ".join(f"word{k % 701}x{k}" for k in range(30_000))
    rows = [(1, None, 1, "x"), (2, "", 1, None), (3, long, 1, None), (3, long, 1, None), (None, long[1000:2000], None, None), (4, "short", 1, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans int, rid string")
    got = {(r["doc_id"], r["n_bytes"]): (list(r["spans"]), len(r["kept"])) for r in suffixdedup.remove_repeats(df).collect()}
    assert got == {(1, 0): ([], 0), (2, 0): ([], 0), (3, len(long)): ([0, len(long)], 0), (None, 1000): ([0, 1000], 0), (4, 5): ([], 5)}
    assert suffixdedup.remove_repeats(df).count() == 6 and suffixdedup.remove_repeats(df.limit(0)).count() == 0
    keyed = suffixdedup.remove_repeats(df.select(df.text.alias("doc_id"), df.text.alias("text")))
    assert keyed.count() == 6
