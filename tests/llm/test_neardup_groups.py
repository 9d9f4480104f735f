"""Large groups of near copies: what is compared, and that no link is lost by it."""

import numpy as np

from triage_spark.llm import neardup


def edited_group(members: int, seed: int) -> dict[int, str]:
    """Copies of one text with 3 to 9 of 150 words changed, each third of them without its last 10 to 60 words."""
    rng = np.random.default_rng(seed)
    texts = {}
    for k in range(members):
        words = [f"w{x}" for x in range(150)]
        for at in rng.choice(150, int(rng.integers(3, 10)), replace=False):
            words[at] = f"e{rng.integers(0, 12)}"
        texts[k] = " ".join(words[: 150 - int(rng.integers(10, 61)) * (k % 3 == 0)])
    return texts


def brute_classes(texts: dict[int, str], percent: int) -> dict[int, int]:
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts.items() for w in [t.split()]}
    first = {k: k for k in sets}

    def root(k):
        while first[k] != k:
            k = first[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    return {k: root(k) for k in sets}


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    compared, verify = [], neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda pairs, *a: compared.append(pairs.count()) or verify(pairs, *a))
    texts = edited_group(600, 3)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, 80).collect()}
    assert got == brute_classes(texts, 80)
    assert sum(compared) < 20 * len(texts)


def test_sketches_bound_the_difference_from_below(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        x = rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64)
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.choice([0, 0.05, 0.1, 0.3])], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        d = len(np.setxor1d(x, y))
        p, q = neardup.sketch(x), neardup.sketch(y)
        assert sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) <= d
        rows.append((180 * d <= 20 * (len(x) + len(y)), len(x), len(y), *p.tolist(), *q.tolist()))
    names = [f"p{k}_{side}" for side in "xy" for k in range(neardup.SKETCH)]
    table = spark.createDataFrame(rows, "near boolean, n_x long, n_y long, " + ", ".join(f"{c} long" for c in names))
    assert table.filter("near").count() > 50
    assert table.filter("near").filter(neardup.near_sketches(80)).count() == table.filter("near").count()
    assert table.filter("NOT near").filter(neardup.near_sketches(80)).count() < table.filter("NOT near").count() / 2


def test_removed_elements_are_needed_within_reach_alone():
    """A pair to be linked, not both near the pivot, shares an added element, or a removed one with each size within the other's reach."""
    rng = np.random.default_rng(21)
    met = by_removed = 0
    for _ in range(6000):
        percent = int(rng.choice([60, 80, 85]))
        base = rng.choice(10**9, int(rng.integers(20, 80)), replace=False)
        extra = rng.choice(10**9, 40)
        edit = lambda s, drop, add: np.unique(np.concatenate([s[rng.random(len(s)) > drop], rng.choice(extra, int(rng.integers(0, add + 1))), base[:1]]))
        m = edit(base, 0, 5)
        x = edit(base, rng.choice([0.1, 0.25, 0.4]), 8)
        y = edit(x, rng.choice([0, 0.05, 0.1]), 3)
        if 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
            continue
        fx, fy = (neardup.differences(m.astype(np.uint64), s.astype(np.uint64), min(map(len, (m, x, y))), percent) for s in (x, y))
        if fx[0] and fy[0]:
            continue
        met += 1
        first = lambda f, k: set(f[k].tolist()[: f[k + 1]])
        if not first(fx, 1) & first(fy, 1):
            by_removed += 1
            assert first(fx, 3) & first(fy, 3) and len(x) <= fy[5] and len(y) <= fx[5]
    assert met > 500 and by_removed > 20
