"""Periodic runs beside a search over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np

from triage_spark.llm import periods, queries

SF = "/root/testdata/sf0.001"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[k] == w[k - q] for k in range(q, len(w))))


def brute(words):
    """Runs by definition: for every period, maximal stretches that keep it, whose smallest period it is."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            z = k
            while z + q < n and words[z] == words[z + q]:
                z += 1
            if z + q - k >= max(6, 4 * q) and smallest_period(words[k : z + q]) == q:
                out.append((k, z + q - k, q))
            k = z + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_runs_beside_brute_force():
    rng = random.Random(5)
    texts = []
    for trial in range(500):
        words = []
        while len(words) < rng.choice([5, 12, 40, 90]):
            part = [rng.choice("ab" if trial % 2 else "abcdefgh") for _ in range(rng.randint(1, 9))]
            words += part * rng.choice([1, 1, 2, 3, 4, 5, 7]) + part[: rng.randint(0, len(part))]
        texts.append([w.encode() for w in words])
    texts += [[b"a"] * 6, [b"a"] * 5, [], [b"a", b"b"] * 4, [b"a", b"b"] * 3 + [b"a"], [b"x"] * 1000]
    found, out = periods.collapse(texts)
    for words, runs, text in zip(texts, found, out):
        runs = [(r["start"], r["length"], r["period"]) for r in runs]
        assert runs == brute(words)
        assert text == b" ".join(collapsed(words, runs))


def test_wavelet_beside_sorting():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    tree = periods.Wavelet(values)
    lo = rng.integers(0, 499, 300)
    hi = lo + 1 + rng.integers(0, 500 - lo)
    x, n = rng.integers(0, 500, 300), rng.integers(0, hi - lo)
    assert tree.below(lo, hi, x).tolist() == [int((values[a:z] < k).sum()) for a, z, k in zip(lo, hi, x)]
    assert tree.nth(lo, hi, n).tolist() == [int(np.sort(values[a:z])[k]) for a, z, k in zip(lo, hi, n)]


def test_op13(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_periods(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and sum(r["n_runs"] > 0 for r in rows) > 5
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        words = (docs[r["doc_id"]] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if len(words) > 1500 and h % 10:
            continue  # brute force takes the square of the words; a test of its own has long texts
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want = (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(collapsed(words, runs)).decode()))
        assert tuple(r)[1:] == want


def test_op13_odd_input(spark, monkeypatch):
    monkeypatch.setattr(periods, "BATCH", 50)
    long = " ".join(f"w{k}" for k in range(3000)) + " la le" * 40_000
    rows = [(1, None, 1), (2, "", 1), (3, " \n\x0b\t", None), (4, long, 2), (None, "x x x\rx x x", 3), (4, long, 2), (5, "a\u00a0a a a a a", 1), (6, "\x1c a " * 5, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words int")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.repeated_words(df).collect()]
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 83_000, [(3000, 80_000, 2)], " ".join([*(f"w{k}" for k in range(3000)), "la", "le"])), (None, 6, [(0, 6, 1)], "x")]
    assert got[:5] == want and got[5] == want[3] and got[6:] == [(5, 4, [], "a\u00a0a a a a a"), (6, 10, [(0, 10, 2)], "\x1c a")]
    assert periods.repeated_words(df.limit(0)).count() == 0
    assert periods.repeated_words(df.select(df.text.alias("doc_id"), "text")).count() == 8
