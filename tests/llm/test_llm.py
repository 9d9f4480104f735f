"""Corpus operators beside brute force, and on nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from triage_spark.llm import decontaminate, fingerprints, graph, langid, linededup, neardup, packing, quality, queries, secretscan, sharding, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, line_start int"
LONG = " ".join(f"word{k % 701}x{k}" for k in range(30_000))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank, long, repeated and tied rows, and columns whose names clash."""
    texts = [None, "", "  \n ", "one", "a b c d e f g", "a b c d e f g", LONG, LONG + " end", "12 34 !!", "zwei\r\ndrei  vier \t"]
    rows = [(k, t, "en" if k % 2 else None, None, None, None, None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "no key here", "de", "s", 3, 1.0, 1, 1)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_op1(spark, docs, edge, empty):
    rows = sorted((r["shard"], r["slot"], r["doc_id"], r["size"], r["text_crc32"]) for r in run(spark, "op1_shards").collect())
    assert [r[2] for r in rows] == sorted(docs)
    total, before, slots = sum(r[3] for r in rows), 0, Counter()
    for s, slot, k, size, crc in rows:
        data = (docs[k] or "").encode()
        assert (size, crc) == (len(data) + 8, zlib.crc32(data))
        assert s == min(23, (2 * before + size) * 24 // (2 * total)) and slot == slots[s]
        slots[s] += 1
        before += size
    got = sharding.shard(edge, 3)
    assert got.count() == edge.count() and got.filter("doc_id IS NULL").first()["shard"] == 0
    assert sharding.shard(empty, 3).count() == 0


def test_op2(spark, docs, edge, empty):
    got = {r["doc_id"]: r for r in run(spark, "op2_language").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [k for k in docs if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[k]["lang_pred"] == truth[k] for k in held) >= 0.95 * len(held)
    model = langid.fit(edge)
    said = {(r["doc_id"], r["text"]): r["lang_pred"] for r in langid.identify(edge, model).collect()}
    assert said[0, None] == said[1, ""] == said[8, "12 34 !!"] == "und" and said[3, "one"] in ("en", "de")
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.fit(empty).predict("text") == ("und", 0.0)


class PlainWordFirst:
    """The language model in plain Python: dictionaries of counts, one word after the other."""

    def __init__(self, rows):
        self.counts = defaultdict(Counter)  # by (language, order)
        for text, lang in rows:
            for w in langid.words_of(text):
                self.counts[lang, 0][w] += 1
                for n in range(1, 6):
                    self.counts[lang, n].update(langid.grams_of(w, n))
        self.langs = sorted({lang for lang, _ in self.counts})
        self.known = [set().union(*(self.counts[lang, n] for lang in self.langs)) for n in range(6)]
        self.total = {key: sum(c.values()) for key, c in self.counts.items()}

    def value(self, n, gram):
        return np.array([np.log((self.counts[lang, n][gram] + 0.5) / (self.total[lang, n] + 0.5 * (len(self.known[n]) + 1))) for lang in self.langs])

    def word(self, w):
        if w in self.known[0]:
            return self.value(0, w)
        for n in range(5, 0, -1):
            if found := [self.value(n, g) for g in langid.grams_of(w, n) if g in self.known[n]]:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text):
        words = [w for w in langid.words_of(text or "") if any(c.isalpha() for c in w)]
        if not words:
            return "und", 0.0
        mean = np.mean([self.word(w) for w in words], axis=0)
        z = np.exp((mean - mean.max()) * min(len(words), 30))
        return self.langs[int(z.argmax())], z.max() / z.sum()


def test_op2_beside_plain_python(spark, docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    plain = PlainWordFirst([(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] and r["lang"]])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in run(spark, "op2_language").collect()}
    short = sorted(docs, key=lambda k: len(docs[k] or ""))[:150]
    for k in short:
        lang, score = plain.predict(docs[k])
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=1e-3)
    texts = ["zzqx", "Ærø 12 ½", "日本語", "½²", "9", None, "una palabra, unos Wörter", " ".join(short_text for short_text in map(str, range(50)))]
    labelled = [("eins zwei drei Wörter", "de"), ("una dos tres palabra", "es"), ("una deux trois", "fr")]
    model = langid.fit(spark.createDataFrame([(k, *r) for k, r in enumerate(labelled)], "doc_id long, text string, lang string"))
    plain = PlainWordFirst(labelled)
    langs, scores = model.predict_all(texts)
    assert langs == [plain.predict(t)[0] for t in texts] and scores == pytest.approx([plain.predict(t)[1] for t in texts], abs=1e-4)


def test_language_reads_long_texts_in_parts(spark, monkeypatch):
    model = langid.fit(spark.createDataFrame([(1, "eins zwei drei vier", "de"), (2, "one two three four", "en")], "doc_id long, text string, lang string"))
    texts = ["zwei drei " * 40, None, "one " * 90 + "eins", "three", "x" * 200]
    whole = model.predict_all(texts)
    monkeypatch.setattr(langid, "PIECE", 16)
    monkeypatch.setattr(langid, "CACHE", 3)
    assert model.predict_all(texts) == whole
    assert "".join(langid.pieces(texts[0])) == texts[0] and max(map(len, langid.pieces(texts[0]))) < 30


def test_op3(spark, docs, edge, empty):
    got = {r["doc_id"]: r for r in run(spark, "op3_fingerprints").collect()}
    keys = sorted(docs)
    by_text = defaultdict(set)
    for k, nxt in zip(keys, [*keys[1:], keys[0]]):
        t, u = docs[k] or "", docs[nxt] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
        by_text[t].add(got[k]["fingerprint"])
        if t == u:
            assert got[k]["near_next"] == 1
    assert all(len(v) == 1 for v in by_text.values())
    long = [k for k in keys if len((docs[k] or "").split()) > 30]
    assert np.mean([got[k]["near_edited"] > got[k]["near_next"] for k in long if got[k]["near_next"] < 1]) > 0.97
    with pytest.raises(ValueError):
        fingerprints.with_next(edge, ["text"], "lang")
    assert fingerprints.fingerprint_with_edits(edge.withColumn("doc_id", F.col("doc_id").cast("int"))).count() == edge.count()
    assert fingerprints.fingerprint_with_edits(empty).count() == 0
    one = edge.filter("doc_id = 3")
    assert fingerprints.fingerprint_with_edits(one).first()["near_next"] == 1


def plain_anchors(text):
    """Closed syncmers of k = 3 words in plain Python: (hash, place)."""
    words = []
    for w in text.lower().split():
        words += list(w) if len(w) > 16 else [w]
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in h]

    def of(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    kept = [i for i in range(len(h) - 2) if min(signed[i : i + 3]) in (signed[i], signed[i + 2])]
    return [(of(signed[i : i + 3]), i) for i in kept] or [(of(signed), 0)]


def plain_match(a, b):
    first = [{}, {}]
    for side, anchors in zip(first, (a, b)):
        for h, pos in anchors:
            side.setdefault(h, pos)
    votes = Counter(first[1][h] - first[0][h] for h in first[0].keys() & first[1].keys())
    return min(((-n, o) for o, n in votes.items()), default=None)


def test_op3_beside_plain_python(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op3_fingerprints").collect()}
    keys = sorted(docs)
    anchors = {k: plain_anchors(docs[k] or "") for k in keys}
    for k, nxt in zip(keys, [*keys[1:], keys[0]]):
        t = docs[k] or ""
        half = len(t) // 2
        edited = plain_anchors(t[: len(t) - half] + (docs[nxt] or "")[:half])
        r, own = got[k], {h for h, _ in anchors[k]}
        assert r["fingerprint"] == base64.b64encode(b"".join(struct.pack(">q", h) for h in sorted(own))).decode() and r["n_anchors"] == len(anchors[k])
        hashes = [{x[i : i + 8] for x in [base64.b64decode(r[c])] for i in range(0, len(x), 8)} for c in ("fingerprint", "edited_fingerprint")]
        assert r["near_edited"] == len(hashes[0] & hashes[1]) / len(hashes[0] | hashes[1])
        for other, near, offset, matched in ((edited, "near_edited", "edited_offset", "edited_matched"), (anchors[nxt], "near_next", "next_offset", "next_matched")):
            hashes = {h for h, _ in other}
            assert r[near] == pytest.approx(len(own & hashes) / len(own | hashes))
            best = plain_match(anchors[k], other)
            assert (r[matched], r[offset]) == ((-best[0], best[1]) if best else (None, None))
    d = spark.createDataFrame([(1, "文" * 20 + "字句章節" * 100), (2, "別" * 30)], "doc_id long, text string")
    assert fingerprints.fingerprint_with_edits(d).filter("doc_id = 1").first()["near_edited"] > 0


def test_syncmers_by_hand(spark):
    d = spark.createDataFrame([("b a d c e f a b",), ("a b",), ("",)], "text string")
    d = d.withColumn("h", fingerprints.word_hashes(F.col("text")))
    for r in fingerprints.add_anchors(d, "text", "anchors").collect():
        h = r["h"]
        want = [i for i in range(len(h) - 2) if min(h[i : i + 3]) in (h[i], h[i + 2])] or [0]
        assert [a["pos"] for a in r["anchors"]] == want
    x = spark.createDataFrame([("q r s t a b c d e f g h", "z z z a b c d e f g h i")], "a string, b string")
    x = fingerprints.add_anchors(fingerprints.add_anchors(x, "a", "p"), "b", "q")
    m = fingerprints.match_positions(x, "p", "q", "m").first()["m"]
    assert m is not None and m["offset"] == -1


def test_op3_cuts_a_text_once(spark):
    """The words are made once for all that reads them; matching is the same however many anchors are common."""
    d = fingerprints.add_anchors(spark.createDataFrame([("a b c",)], "text string"), "text", "anchors")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1
    rng = np.random.default_rng(3)
    rows = [[[(int(h), p) for p, h in enumerate(rng.integers(-n, n, size))] for size in (n, n + 3)] for n in (1, 2, 5, 12, 40, 90)]
    kind = "array<struct<hash: bigint, pos: int>>"
    got = fingerprints.match_positions(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], f"k int, a {kind}, b {kind}"), "a", "b", "m")
    for r in got.collect():
        best = plain_match(*rows[r["k"]])
        assert (r["m"] and (r["m"]["anchors"], r["m"]["offset"])) == ((-best[0], best[1]) if best else None)


def brute_leaks(texts, items, overlap=0.8, part=0.5):
    out = set()
    for k, t in texts.items():
        words = decontaminate.words_of(t or "")
        for i, b in items.items():
            own = decontaminate.words_of(b or "")
            if not own or not words:
                continue
            parts = [decontaminate.shingles(p) for p in (own, *decontaminate.question_answer(b))]
            for at in range(0, max(1, len(words)), 5):
                passage, cache = words[at : at + 2 * len(own)], {}
                if all(decontaminate.share(p, passage, cache) >= x for p, x in zip(parts, (overlap, part, part))):
                    out.add((k, i))
                    break
    return out


def test_op4(spark, docs, edge, empty):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op4_leaks").collect()}
    exact = {(k, i) for k, t in docs.items() for i, b in items.items() if b in (t or "")}
    assert exact and exact <= got and got <= brute_leaks(docs, items)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = decontaminate.find_leaks(spark.read.parquet(f"{SF}/documents.parquet"), bench, max_bytes=2000)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got
    assert decontaminate.find_leaks(edge, bench).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(edge, bench.filter("item_id < 0")).count() == 0
    for wrong in ({"item_key": "doc_id"}, {"threshold": 0.0}):
        with pytest.raises(ValueError):
            decontaminate.find_leaks(edge, bench, **wrong)
    own = edge.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 4")
    assert {r["doc_id"] for r in decontaminate.find_leaks(edge, own).collect()} == {4, 5}


def test_op4_recall_of_edited_items(spark):
    """Items with some words replaced, inside other text: all that brute force finds are found, at low thresholds too."""
    rng = np.random.default_rng(11)
    items = {k: " ".join(f"w{x}" for x in rng.zipf(1.2, int(rng.integers(20, 60))) % 4000) + ". " + " ".join(f"a{x}" for x in rng.integers(0, 300, 12)) + "." for k in range(40)}
    texts = {}
    for k in range(160):
        words = items[k % 40].split()
        for at in rng.choice(len(words), int(rng.integers(0, 4)), replace=False):
            words[at] = f"n{rng.integers(10**6)}"
        around = [f"w{x}" for x in rng.zipf(1.2, int(rng.integers(0, 300))) % 4000]
        cut = int(rng.integers(0, len(around) + 1))
        texts[k] = " ".join([*around[:cut], *words, *around[cut:]])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for overlap, threshold in ((0.8, 0.6), (0.5, 0.2)):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, threshold, overlap, 0.3).collect()}
        want = brute_leaks(texts, items, overlap, 0.3)
        assert len(want) > 60 and got >= want


def test_wand_finds_what_full_scoring_finds():
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 300)) for k in range(120)]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    index = decontaminate.BlockMaxIndex(items, df, len(items), 30)
    for _ in range(60):
        base = decontaminate.words_of(items[rng.integers(120)][1])
        words = set(base[: rng.integers(1, 31)]) | {f"w{x}" for x in rng.integers(0, 300, 20)}
        terms = [index.term[w] for w in words if w in index.term]
        scores = np.zeros(len(items))
        for t in terms:
            scores[index.docs[t]] += index.impacts[t]
        for threshold in (0.3, 0.6, 0.9):
            assert [d for d, _ in index.search(terms, threshold)] == np.flatnonzero(scores >= threshold - 1e-9).tolist()


def test_op5(spark, edge, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = entry.queries()["op5_quality"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    pos, neg = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([a > b for a in pos for b in neg]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = quality.fit(empty, labels)
    assert {r["predicted"] for r in quality.score(edge, none).collect()} <= {0, 1} and quality.score(edge, none).count() == edge.count()
    few = quality.fit(edge, spark.createDataFrame([(4, 1), (6, 0), (None, 1)], "doc_id long, quality int"))
    assert quality.score(edge, few).filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(empty, few).count() == 0


def test_op6(spark, docs, edge, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))

    def check(rows, texts):
        ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
        spans, windows = defaultdict(list), defaultdict(list)
        for r in rows:
            part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            spans[r["doc_id"]].append((r["start"], r["length"]))
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
        for places, whole in [(spans[k], len(v)) for k, v in ids.items()] + [(w, None) for w in windows.values()]:
            at = 0
            for start, length in sorted(places):
                assert start == at and length > 0
                at += length
            assert at <= 1024 if whole is None else at == whole
        return sum(len(v) for v in ids.values()) / (1024 * len(windows))

    assert check(run(spark, "op6_packing").collect(), docs) > 0.97
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = {k: v for k, v in enumerate([None, "", " ", "a  b", "x \n y", "tail \n ", "<|endoftext|> hi", "x <|endoftext|> y<|endoftext|><|endoftext|>", " <|endoftext|>\n ", "a\n \nb", "word " * 3000, "é中\U0001f600 mix"])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(d, path, pattern, added=added).collect(), texts)
    assert packing.pack(empty, path, pattern).count() == 0
    with_ids = packing.pack(edge, path, pattern, with_ids=True)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in with_ids.collect())


def test_differencing_balances():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 2), (40, 7), (300, 60)):
        sizes = rng.integers(1, 257, n).tolist()
        bins, most = packing.differencing(sizes, m)
        loads = np.bincount(bins, weights=sizes, minlength=m)
        assert loads.max() == most and loads.sum() == sum(sizes)
        assert n < 40 or most - loads.min() <= 0.06 * loads.mean()
    assert packing.differencing([8, 7, 6, 5, 4], 2)[1] == 16


def test_op7(spark):
    entries = spark.createDataFrame([("a.com", "l", "add", 10), ("a.com", "l", "remove", 20), ("a.com", "l", "add", 30), ("x.a.com", "m", "add", 5), ("a.com", "l", "add", 31), (None, "l", "add", 1), ("b.org", "l", "add", 7), ("b.org", "l", "remove", 7)], "domain string, list_name string, action string, day int")
    captures = [(1, "http://x.a.com/", 4), (2, "http://u:p@X.A.com:80/q", 6), (3, "https://www.a.com", 19), (4, "http://a.com", 20), (5, "http://a.com", 30), (6, None, 6), (7, "http://nota.com", 15), (8, "http://b.org", 8), (9, "http://a.com", None), (4, "http://a.com", 20)]
    d = spark.createDataFrame(captures, "page_id long, url string, fetched_day int")
    got = {r["page_id"]: (r["blocked"], r["domain"], r["copies"]) for r in urlfilter.evaluate(d, entries).collect()}
    assert got == {1: (False, None, 1), 2: (True, "x.a.com", 1), 3: (True, "a.com", 1), 4: (False, None, 2), 5: (True, "a.com", 1), 6: (False, None, 1), 7: (False, None, 1), 8: (False, None, 1), 9: (False, None, 1)}
    assert urlfilter.evaluate(d, entries.limit(0)).filter("blocked").count() == 0
    assert urlfilter.evaluate(d.limit(0), entries).count() == 0


def brute_classes(texts, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def test_op8(spark, docs, edge, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op8_near_duplicates").collect()}
    assert got == brute_classes(docs)
    rows = neardup.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[7]["component_id"] == 6
    assert neardup.near_duplicates(empty).count() == 0


def test_pipeline_takes_near_copies_from_80_percent(spark):
    assert (neardup.collections_for(85), neardup.collections_for(80)) == (11, 14)
    assert neardup.missed(0.8, 14) <= neardup.MISS < neardup.missed(0.8, 13)
    assert neardup.missed(0.85, 11) == pytest.approx(5.24e-4, rel=0.01)
    rng = np.random.default_rng(8)
    texts = {}
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(104)]
        texts[2 * k] = " ".join(words)
        for at in rng.choice(20, 1 + k % 4, replace=False):
            words[4 + 5 * at] = f"e{k}y{at}"
        texts[2 * k + 1] = " ".join(words)
    likeness = {k: len(a & b) / len(a | b) for k in texts if k % 2 for a, b in [[{tuple(w[i : i + 5]) for i in range(100)} for w in (texts[k - 1].split(), texts[k].split())]]}
    assert sum(0.8 <= x < 0.85 for x in likeness.values()) == 10 and min(likeness.values()) < 0.8
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()} == {k for k in texts if likeness.get(k, 0) < 0.8}


def test_op8_large_class(spark):
    """A class of many near copies and stragglers that only some of its members link to."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(90)]
    texts = {}
    for k in range(260):
        words = list(base)
        for at in rng.choice(90, int(rng.integers(0, 4)), replace=False):
            words[at] = f"e{rng.integers(0, 40)}"
        texts[k] = " ".join(words)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_classes(texts)


def test_shared_differences_lose_no_link():
    """A pair that is to be linked, with one of both far from the pivot, shares an element of the lists."""
    rng = np.random.default_rng(12)
    met = 0
    for _ in range(4000):
        percent = int(rng.choice([60, 80, 85, 95]))
        near = lambda a, b, p=percent: 100 * len(a & b) >= p * len(a | b)
        base = set(rng.choice(10**9, int(rng.integers(5, 80)), replace=False).tolist())
        extra = rng.choice(10**9, 60).tolist()

        def edited(source, drop, add):
            kept = {e for e in source if rng.random() > drop}
            return kept | set(rng.choice(extra, int(rng.integers(0, add + 1))).tolist()) or {1}

        m = edited(base, rng.choice([0, 0.1, 0.3]), int(rng.integers(0, 20)))
        x = edited(base, rng.choice([0, 0.1, 0.3]), int(rng.integers(0, 20)))
        y = edited(x, rng.choice([0, 0.03, 0.1]), int(rng.integers(0, 5)))
        lo = min(map(len, (m, x, y)))
        arrays = {name: np.array(sorted(s), dtype=np.uint64) for name, s in (("m", m), ("x", x), ("y", y))}
        found = {name: neardup.differences(arrays["m"], arrays[name], lo, percent) for name in "xy"}
        assert [found[n][0] for n in "xy"] == [near(m, x), near(m, y)]
        if near(x, y) and not (near(m, x) and near(m, y)):
            met += 1
            for order in (lambda e: e, lambda e: -e, lambda e: e * 7919 % 10007):  # whatever the order of the elements
                first = [[{*sorted(found[n][k].tolist(), key=order)[: found[n][k + 1]]} for k in (1, 3)] for n in "xy"]
                assert first[0][0] & first[1][0] or first[0][1] & first[1][1]
    assert met > 300


def test_op8_one_large_group_and_recall(spark):
    """1,000 edited copies of one text, most of them near the threshold, and 400 pairs at 85 % exactly."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(150)]
    texts = {}
    for k in range(1000):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            words[at] = f"e{rng.integers(0, 10**6)}"
        texts[k] = " ".join(words)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_classes(texts)
    pairs = {}
    for k in range(400):  # 185 shingles each, of which 170 are shared: 100 * 170 = 85 * 200
        words = [f"p{k}x{i}" for i in range(189)]
        pairs[2 * k] = " ".join(words)
        for at in (20, 90, 150):
            words[at] = f"q{k}y{at}"
        pairs[2 * k + 1] = " ".join(words)
    d = spark.createDataFrame(list(pairs.items()), "doc_id long, text string")
    linked = sum(r["doc_id"] % 2 == 1 and not r["kept"] for r in neardup.near_duplicates(d).collect())
    assert linked >= 398  # each is missed with a probability of 5.2e-4


def test_op8_keys_of_any_type_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [("b", t), ("a", t + " x"), (None, t), (None, "one two"), ("c", "other words"), ("a", "quite another text under the same key"), ("a", t + " x")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "node string, component string"), key="node", text="component").collect()
    assert Counter((r["node"], r["component_id"], r["kept"]) for r in got) == {("b", "a", False): 1, ("a", "a", True): 3 - 1, ("a", "a", False): 1, (None, "a", False): 1, (None, None, True): 1, ("c", "c", True): 1}
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id string, text string, head int")
    kept = corpus_pipeline.near_duplicates(spark, d, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("a", rows[1][1]), ("None", "one two"), ("c", "other words"), ("a", rows[5][1])])


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (95, 95)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_op9(spark, docs, edge, empty):
    for r in run(spark, "op9_secrets").collect():
        spans = secretscan.find_spans(docs[r["doc_id"]] or "")
        assert r["base_sha256"] == secretscan.digest(spans)
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r["n_hex"] == len([m for m in re.finditer("[0-9a-f]+", docs[r["doc_id"]] or "") if len(m[0]) >= 32])
    found = secretscan.find_spans("\U0001f600 API-key apikey: 'Zx9/kQ2vLmTr' PASSWORD=password123 AKIA" + "B" * 12)
    assert [(k, a) for a, _, k in found] == [("assign", 10), ("guess", 19), ("assign", 33), ("access", 54)]
    assert secretscan.scan(edge).filter(F.size("secrets") > 0).count() == 0 and secretscan.scan(empty).count() == 0


def brute_cost(value):
    """The least cost over all segmentations, tried one by one with the same span prices."""
    whole = {}
    size = secretscan.math.log10(secretscan.alphabet(value))
    for i in range(len(value)):
        for j in range(i + 1, len(value) + 1):
            cost = (j - i) * size
            rank = {w: k + 1 for k, w in enumerate(secretscan.COMMON)}.get(value[i:j])
            if rank:
                cost = min(cost, secretscan.math.log10(rank + 1))
            whole[i, j] = cost

    def best(j):
        return 0.0 if j == 0 else min(best(i) + whole[i, j] + (0.3 if i else 0.0) for i in range(j))

    return best(len(value))


def test_op9_gate_lets_every_credential_word_through():
    value = "Xk9#mQ2$vL"
    for word in ("pass", "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "credentials", "privatekey", "private_key", "auth"):
        for name in (word, word.upper(), f"db_{word}"):
            for text in (f"{name}: {value}", f'"{name}" = "{value}"', f"{name}={value}", f"{name} is {value}"):
                at = text.index(value)
                assert (at, at + len(value), "guess") in secretscan.find_spans(text), text
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        assert (0, len(word) + 9, "assign") in secretscan.find_spans(f"{word}=abcdefgh")


def all_spans_cost(value):
    """The least cost over every repeat, walk and brute-force span, built one by one."""
    size, low, best = secretscan.math.log10(secretscan.alphabet(value)), value.lower(), [0.0]
    log = secretscan.math.log10
    for j in range(1, len(value) + 1):
        options = []
        for i in range(j):
            n, costs = j - i, [(j - i) * size]
            costs += [u * size + log(n // u) for u in (1, 2, 3, 4) if n % u == 0 and n >= max(3, 2 * u) and value[i:j] == value[i : i + u] * (n // u)]
            if n >= 3 and all(p in secretscan.NEXT_TO for p in zip(low[i:j], low[i + 1 : j])):
                costs.append(log(len(secretscan.ROWS) * 10 * n * 2))
            options.append(best[i] + min(costs) + (0.3 if i else 0.0))
        best.append(min(options))
    return best[-1]


def test_op9_takes_whole_values():
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghXYZ0123456789+/_-"), 5000))
    for word in ("auth", "pwd", "credentials", "private_key", "token"):
        assert (len(word) + 2, len(word) + 2 + len(long), "guess") in secretscan.find_spans(f"{word}: {long} after")
    for _ in range(300):
        v = "".join(rng.choice([*"qwe1", "ab", "abab", "zzzz", "qwerty", "xyz" * 3, "1212"], rng.integers(1, 9)))
        assert secretscan.guess_cost(v, {"none such": 1})[0] == pytest.approx(all_spans_cost(v))
    for v in ("a" * 40_000, "ab" * 20_000, "qwerty" * 7_000):
        start = time.process_time()
        assert secretscan.guess_cost(v)[1][-1][2] == len(v)
        assert time.process_time() - start < 20


def test_op9_learns_words(spark, monkeypatch):
    prose = ["An answer is required and the response was missing.", "Response times: nothing required, missing or simple.", "Simple words."]
    keys = ["password: required", "token = response", "the secret is simple", "auth is missing", "pwd: fjqkzmvxtr", "pwd: fjqkzmvxtr", "pwd: Xk9#mQ2$vL"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate([*prose, *keys, None])], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in secretscan.scan(d).collect()}
    assert [k for k in sorted(got) if "guess" in got[k]] == [7, 8, 9]
    assert "guess" in [k for _, _, k in secretscan.find_spans("password: required")]
    words = secretscan.learned_words(d)
    assert words["password"] == 1 and "fjqkzmvxtr" not in words and {"required", "response", "simple", "missing"} <= set(words)
    for most, want in ((6, {"pwd", "the", "required", "response", "missing", "simple"}), (5, {"pwd"})):
        monkeypatch.setattr(secretscan, "MOST_WORDS", most)
        assert set(secretscan.learned_words(d)) - set(secretscan.COMMON) == want
    assert secretscan.guess_cost("2019990101")[1] == [("brute", 0, 2), ("date", 2, 10)]


def test_guess_cost():
    for v in ("xkpassword", "dragonzq", "zqvmjx"):
        assert secretscan.guess_cost(v)[0] == pytest.approx(brute_cost(v))
    assert [k for k, _, _ in secretscan.guess_cost("password123")[1]] == ["word", "walk"]
    assert secretscan.guess_cost("aaaaaaaaaaaa")[0] < 4 < 12 < secretscan.guess_cost("Xk9#mQ2$vL")[0]


def brute_runs(texts, min_words):
    """Lines in a run of at least min_words words that stands at an earlier place.

    Of the runs only the shortest from each line on, and back from each line, are tried: each repeated run is the union of some.
    """
    seen, gone = set(), set()
    for k in sorted(texts):
        lines = [x.strip() for x in (texts[k] or "").split("\n")]
        n = [len(x.split()) for x in lines]
        spans = set()
        for s in range(len(lines)):
            e = next((e for e in range(s + 1, len(lines) + 1) if sum(n[s:e]) >= min_words), None)
            b = next((b for b in range(s, -1, -1) if sum(n[b : s + 1]) >= min_words), None)
            spans |= {(s, e)} if e is not None else set()
            spans |= {(b, s + 1)} if b is not None else set()
        for s, e in sorted(spans):
            run = tuple(lines[s:e])
            if run in seen:
                gone |= {(k, i) for i in range(s, e)}
            seen.add(run)
    return gone


def test_op10(spark, docs, edge, empty):
    got = run(spark, "op10_repeated_lines").collect()
    assert {(r["doc_id"], i) for r in got for i in range(r["line_start"], r["line_end"])} == brute_runs(docs, linededup.MIN_WORDS)
    assert all((r["first_doc_id"], r["first_line"]) < (r["doc_id"], r["line_start"]) for r in got)
    lines_of = lambda k: [x.strip() for x in docs[k].split("\n")]
    for r in got:  # each run stands, whole, at the place that is named
        n = r["line_end"] - r["line_start"]
        assert lines_of(r["doc_id"])[r["line_start"] : r["line_end"]] == lines_of(r["first_doc_id"])[r["first_line"] : r["first_line"] + n]
    rng = np.random.default_rng(2)
    texts = {k: "\n".join(f"line {x} of it" for x in rng.integers(0, 4, rng.integers(1, 12))) for k in range(40)}
    d = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string")
    runs = linededup.repeated_runs(d, 12)
    assert {(r["doc_id"], i) for r in runs.collect() for i in range(r["line_start"], r["line_end"])} == brute_runs(texts, 12)
    cut = {r["doc_id"]: r["text"] for r in linededup.remove_runs(d, runs).collect()}
    gone = brute_runs(texts, 12)
    assert cut == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in texts.items()}
    on_edge = linededup.repeated_runs(edge, 3)
    assert {r["doc_id"] for r in on_edge.collect()} == {5}
    assert linededup.remove_runs(edge, on_edge).columns == [*edge.columns, "removed_lines"]
    assert linededup.remove_runs(empty, linededup.repeated_runs(empty)).count() == 0


def test_op10_runs_stay_with_their_source(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(35)) for x in "ab")
    d = spark.createDataFrame([(1, a, 0, 7), (2, f"x\n{b}", 0, 7), (3, f"{a}\n{b}", 0, 7)], "sid long, spans__ string, sid__ int, removed_lines int")
    with pytest.raises(ValueError):
        linededup.repeated_runs(d, 30, "sid", "spans__")
    d = d.withColumnsRenamed({"sid": "row", "spans__": "whole", "sid__": "left"})
    runs = linededup.repeated_runs(d, 30, "row", "whole")
    assert sorted(tuple(r)[1:] for r in runs.collect()) == [(3, 0, 1, 1, 0), (3, 1, 2, 2, 1)]
    cut = linededup.remove_runs(d, runs, "row", "whole")
    assert cut.columns == ["row", "whole", "left", "removed_lines"]
    assert sorted(map(tuple, cut.collect())) == [(1, a, 0, 0), (2, f"x\n{b}", 0, 0), (3, "", 0, 2)]


def maximal_runs(texts, min_words):
    """Lines in a run of any length from min_words words on that stands at an earlier place."""
    seen, gone = set(), set()
    for k in sorted(texts):
        lines = [x.strip() for x in (texts[k] or "").split("\n")]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(lines[s:e])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone |= {(k, i) for i in range(s, e)}
                    seen.add(run)
    return gone


def test_op10_runs_reach_their_ends(spark):
    words = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    whole = "\n".join(words(n, x) for n, x in ((99, "a"), (62, "b"), (87, "c"), (2, "d")))
    tail = "\n".join([words(31, "e"), "", words(1, "f"), "", ""])
    texts = {0: whole, 1: whole, 2: f"own\n{whole}\nother", 3: tail, 4: f"{tail}x", 5: f"\n{tail}"}
    rng = np.random.default_rng(4)
    texts |= {k: "\n".join(words(x, "w") for x in rng.integers(0, 6, rng.integers(1, 14))) for k in range(6, 50)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for least in (9, 30):
        runs = linededup.repeated_runs(d, least)
        got = {(r["doc_id"], i) for r in runs.collect() for i in range(r["line_start"], r["line_end"])}
        assert got == maximal_runs(texts, least)
    assert {(1, 3), (2, 4), (4, 1), (4, 2), (4, 3)} <= got


def test_pipeline_drops_what_line_dedup_leaves_blank(spark):
    text = " ".join(f"a{i}" for i in range(31))
    d = spark.createDataFrame([(0, text, "en", "s", 9), (1, f"\n\u2003\n{text}\n \t\n", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.lines(spark, d, SF).collect()] == [0]


def test_pipeline(spark, docs, edge):
    """Each stage on what the one before kept, beside plain Python."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    now = dict(docs)
    plain = PlainWordFirst([(r["text"], r["lang"]) for r in d.dropna(subset=["text", "lang"]).collect()])
    odd = [(10**6, "日本語の文章です", None, None, None), (10**6 + 1, "12 34", None, None, None), (10**6 + 2, docs[0], None, None, None), (0, docs[0], "en", "again", 1)]
    d = d.unionByName(spark.createDataFrame(odd, d.schema))
    now |= {r[0]: r[1] for r in odd}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            said = {k: plain.predict(t) for k, t in now.items()}
            now = {k: t for k, t in now.items() if said[k][1] > 0.2501}  # all of the table is in its languages, so no coverage turns a text away
            assert 10**6 not in now and 10**6 + 1 not in now and len(now) >= len(docs) - 5
            assert d.filter("doc_id = 1000002").first()["lang"] == said[0][0]
        elif name == "line dedup":
            gone = brute_runs(now, linededup.MIN_WORDS)
            cut = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in now.items()}
            now = {k: t for k, t in cut.items() if t.strip() or t == now[k]}
        elif name == "near duplicates":
            now = {k: now[k] for k, v in brute_classes(now, 80).items() if v[2]}
        else:
            now = {k: t for k, t in now.items() if not any(b in t for b in items.values())}
        rows = d.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == now, name
        assert len(rows) == len(now) + (name in ("language", "line dedup"))
    packed = corpus_pipeline.pack(spark, d, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(now)
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in packed.collect())
    e = edge.drop("score", "node", "line_start")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        e = stage(spark, e, SF)
    assert {r["doc_id"] for r in e.collect()} >= {3, 4, 6}


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_language_learns_from_all_rows(spark):
    """More labelled rows than the 2,048 that were taken before; each has a word of its own, which all count."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.translate(F.concat(F.lit("w"), F.col("id") + 10000), "0123456789", "abcdefghij").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    model = langid.fit(d)
    assert len(model.tables[0][0]) == 3000
    small = langid.fit(d.unionByName(d.filter("doc_id < 100")), entries=150)
    assert len(small.tables[0][0]) == 100  # the commonest; totals are of all words
    assert small.tables[0][1].max() == pytest.approx(np.log(2.5 / (1550 + 0.5 * 3001)), abs=1e-5)
