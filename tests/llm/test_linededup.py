"""Repeated runs of lines: a stretch that an earlier place holds whole is one run."""

import numpy as np

from triage_spark.llm import linededup


def words(n, x):
    return " ".join(f"{x}{i}" for i in range(n))


def brute_stretches(texts, min_words):
    """Stretches (document, start, stop) of lines in repeated windows that overlap or touch, and the first earlier place of each that has one."""
    lines = {k: [x.strip() for x in t.split("\n")] for k, t in texts.items()}
    seen, out = set(), {}
    for k in sorted(lines):
        own, spans = lines[k], []
        n = [len(x.split()) for x in own]
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                if sum(n[s:e]) >= min_words:
                    if tuple(own[s:e]) in seen:
                        spans.append((s, e))
                    seen.add(tuple(own[s:e]))
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            part = own[s:e]
            out[k, s, e] = next(((j, i) for j in sorted(lines) for i in range(len(lines[j]) - len(part) + 1) if (j, i) < (k, s) and lines[j][i : i + len(part)] == part), None)
    return out


def check(spark, texts, least):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["line_start"], r["line_end"]): (r["first_key"], r["first_line"]) for r in linededup.repeated_runs(d, least).collect()}
    want = brute_stretches(texts, least)
    for (k, s, e), first in want.items():
        inside = {x: f for x, f in got.items() if x[0] == k and x[1] < e and x[2] > s}
        if first:
            assert inside == {(k, s, e): first}
        assert {i for _, a, z in inside for i in range(a, z)} == set(range(s, e))
    assert all(any(k == j and s <= a and z <= e for j, s, e in want) for k, a, z in got)
    for (k, a, z), (j, b) in got.items():
        assert [x.strip() for x in texts[k].split("\n")][a:z] == [x.strip() for x in texts[j].split("\n")][b : b + z - a] and (j, b) < (k, a)
    return got


def test_runs_of_lines_that_touch(spark):
    a, b, c, d = (words(30, x) for x in "abcd")
    texts = {1: f"{a}\n{b}", 2: f"{c}\n{a}\n{b}\n{d}", 3: f"own\n{c}\n{a}\n{b}\n{d}", 4: f"{d}\n{a}"}
    assert check(spark, texts, 30) == {(2, 1, 3): (1, 0), (3, 1, 5): (2, 0), (4, 0, 1): (2, 3), (4, 1, 2): (1, 0)}


def test_runs_beside_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [words(int(n), f"l{k}_") for k, n in enumerate(rng.integers(1, 40, 60))]
    texts = {k: "\n".join(base[a : a + int(rng.integers(1, 25))] + [words(5, f"own{k}_")]) for k, a in enumerate(rng.integers(0, 50, 40).tolist())}
    texts |= {100: "\n".join(base), 101: "\n".join(base), 102: "\n".join([*base[:20], "x", *base[20:]])}
    check(spark, texts, 30)
