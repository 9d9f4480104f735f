"""Language of whole texts: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import BATCH, forget, stored, trim
from triage_spark.operators.features import order_statistics

WORDS = re.compile(r"[^\W\d_]+")
NO_WORD = re.compile(r"[\W\d_]")
MAX_GRAM = 5
COVER = 4  # characters of the n-grams by which a word is a language's
LOW = 0.8  # of the lowest labelled texts' coverage
CERTAIN = 3.0  # standard errors by which a text must lie outside
SURE = 30.0  # words from which on a text's score stops growing
PIECE = 1 << 18  # characters of a text that one step takes
STEP_WORDS = 1 << 15  # words that are looked up together
ENTRIES = 1 << 19  # of a model, of each order
CACHE, LONG = 150_000, 64  # words that a worker remembers; letters of the longest of them
STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE characters, never cut inside a word."""
    at = 0
    while len(text) - at > PIECE:
        m = NO_WORD.search(text, at + PIECE)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word; from two on its ends count as the characters < and >."""
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def gram_hashes(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hash of each n-gram of all words, word it belongs to) for n = 1 to MAX_GRAM."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    left = ends[owner] - np.arange(len(chars))  # characters from here to the word's end, both included
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, MAX_GRAM + 1):
        h = h[: max(0, len(chars) - n + 1)] * STEP + chars[n - 1 :] + np.uint64(n)
        h ^= h >> np.uint64(29)
        inside = left[: len(h)] >= n
        if n == 1:
            inside = (left > 1) & (left < size[owner])
        yield n, h[inside], owner[: len(h)][inside]


class WordFirst:
    """Log frequencies by language of words and of character n-grams.

    tables[0] holds words, tables[n] n-grams: sorted 64-bit hashes, and a row of log frequencies for each.
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables
        self._start()

    def _start(self):
        self.place: dict[str, int] = {}  # of words in `known`; 0 stands for words without a letter
        self.known = np.zeros((1, 2 * len(self.langs)))  # scores, then how far each language has the word
        self.absent = [rows.min(axis=0, initial=0) + 0.5 for _, rows in self.tables]  # above it an entry was seen in the language at least once

    def __getstate__(self):
        return {"langs": self.langs, "tables": self.tables}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[n]
        if not len(keys):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: of the word itself, else the mean of its longest n-grams of which some are known, else zeros.

        Then, by language, the share of the word that it has: 1 for a word of its own, else the part of its COVER-grams.
        """
        out, cover = np.zeros((len(words), len(self.langs))), np.zeros((len(words), len(self.langs)))
        if not words or not self.langs:
            return np.concatenate([out, cover], axis=1)
        hit, at = self.find(0, word_hashes(words))
        out[hit] = self.tables[0][1][at[hit]]
        cover[hit] = out[hit] > self.absent[0]
        grams = np.flatnonzero(~cover.any(axis=1))
        if len(grams):
            for n, h, owner in gram_hashes([words[k] for k in grams]):
                if n == COVER:
                    known, at = self.find(n, h)
                    has = self.tables[n][1][at[known]] > self.absent[n]
                    each = np.maximum(np.bincount(owner, minlength=len(grams)), 1)
                    for k in range(len(self.langs)):
                        cover[grams, k] = np.bincount(owner[known], weights=has[:, k], minlength=len(grams)) / each
        todo = np.flatnonzero(~hit)
        if len(todo):
            for n, h, owner in reversed(list(gram_hashes([words[k] for k in todo]))):
                hit, at = self.find(n, h)
                own, rows = owner[hit], self.tables[n][1][at[hit]]
                times = np.bincount(own, minlength=len(todo))
                fresh = (times > 0) & (todo >= 0)
                if fresh.any():
                    sums = np.stack([np.bincount(own, weights=rows[:, k], minlength=len(todo)) for k in range(len(self.langs))], axis=1)
                    out[todo[fresh]] = sums[fresh] / times[fresh, None]
                    todo = np.where(fresh, -1, todo)
        return np.concatenate([out, cover], axis=1)

    def places(self, words: list[str]) -> np.ndarray:
        found = list(map(self.place.get, words))
        if None in found:
            if len(self.known) > CACHE:
                self._start()
            new = list(dict.fromkeys(w for w in words if w not in self.place))
            letters = [w for w in new if any(map(str.isalpha, w))]
            self.place.update(dict.fromkeys(new, 0))
            self.place.update(zip(letters, range(len(self.known), len(self.known) + len(letters))))
            self.known = np.concatenate([self.known, self.scores(letters)])
            found = list(map(self.place.get, words))
            for w in new:
                if len(w) > LONG:
                    del self.place[w]
        return np.array(found, dtype=np.int64)

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; texts without a letter are 'und'."""
        return self.read(texts)[:2]

    def read(self, texts: list[str | None], coverage: bool = False) -> tuple[list[str], list[float], list[float]]:
        """Language and score of each text, and the most that its share of the language's words and COVER-grams can be.

        The last is the upper end of a Wilson interval (z = CERTAIN) over the text's words, so that a short text is not held to
        what chance made of a few words.
        """
        sums, n = np.zeros((len(texts), (1 + coverage) * len(self.langs))), np.zeros(len(texts))
        words: list[str] = []
        owners: list[int] = []
        lengths: list[int] = []

        def add():
            at, owner = self.places(words), np.repeat(owners, lengths)
            n[:] += np.bincount(owner, weights=at > 0, minlength=len(texts))
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(owner, weights=self.known[at, k], minlength=len(texts))
            words.clear(), owners.clear(), lengths.clear()

        for k, t in enumerate(texts):
            for piece in pieces(t or ""):
                part = words_of(piece)
                words.extend(part)
                owners.append(k)
                lengths.append(len(part))
                if len(words) >= STEP_WORDS:
                    add()
        if words:
            add()
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        sums, covered = sums[:, : len(self.langs)], sums[:, len(self.langs) :]
        mean = sums / np.maximum(n, 1)[:, None]
        z = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, SURE)[:, None])
        best = z.argmax(axis=1)
        share = z[np.arange(len(texts)), best] / z.sum(axis=1)
        most = np.zeros(len(texts))
        if coverage:
            words_n, c, z2 = np.maximum(n, 1), covered[np.arange(len(texts)), best] / np.maximum(n, 1), CERTAIN**2
            most = (c + z2 / (2 * words_n) + CERTAIN * np.sqrt(c * (1 - c) / words_n + z2 / (4 * words_n**2))) / (1 + z2 / words_n)
        return [self.langs[k] if m else "und" for k, m in zip(best, n)], np.where(n > 0, share, 0.0).tolist(), np.where(n > 0, most, 0.0).tolist()

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.predict_all([text])
        return langs[0], scores[0]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", entries: int = ENTRIES) -> WordFirst:
    """Learn from all labelled rows: every word and n-gram of theirs is counted.

    Words are counted first, by task and then on Spark; n-grams are counted from the distinct words, as often as these stand there.
    An entry takes 8 bytes of hash and 4 bytes a language. Of each order (words, n-grams of one length) at most `entries` are
    kept, those counted most often in all rows; all orders' totals and numbers of entries are of everything counted. A word that is not
    kept is read by its n-grams. What reaches the driver is the packed tables. Rows with null text or label teach nothing;
    an empty table gives a model that answers 'und'.
    """
    rows = docs.select(text, lang).dropna()

    def frames(seen: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lg, words in seen.items():
            if words:
                yield pd.DataFrame({"lang": lg, "word": list(words), "c": list(words.values())})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        held = 0  # words of all languages together
        for b in batches:
            for t, lg in zip(b[text], b[lang]):
                own = seen.setdefault(lg, Counter())
                for piece in pieces(t):
                    held -= len(own)
                    own.update(words_of(piece))
                    held += len(own)
                    if held > CACHE:
                        yield from frames(seen)
                        seen, own, held = {lg: (fresh := Counter())}, fresh, 0
        yield from frames(seen)
        trim()

    def grams(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for lg, part in b.groupby("lang"):
            words, times = part["word"].tolist(), part["c"].to_numpy(np.int64)
            for n, h, c in [(0, word_hashes(words), times), *((n, h, times[owner]) for n, h, owner in gram_hashes(words))]:
                u, inverse = np.unique(h, return_inverse=True)
                yield pd.DataFrame({"lang": lg, "n": n, "h": u.view(np.int64), "c": np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= STEP_WORDS:
                yield from grams(pd.concat(held))
                held = []
        if held:
            yield from grams(pd.concat(held))
        trim()

    words = stored(rows.mapInPandas(count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), BATCH)
    counted = stored(words.mapInPandas(expand, "lang string, n int, h long, c long").groupBy("n", "h", "lang").agg(F.sum("c").alias("c")))
    forget(words)
    totals = {(r["lang"], r["n"]): r["c"] for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    langs = sorted({k[0] for k in totals})
    by_lang = [F.sum(F.when(F.col("lang") == lg, F.col("c")).otherwise(0)).cast("float").alias(f"c{k}") for k, lg in enumerate(langs)]
    each = counted.groupBy("n", "h").agg(F.sum("c").alias("all"), *by_lang).withColumn("level", F.floor(F.log2("all") * 16)) if langs else None
    sizes, least = Counter(), dict.fromkeys(range(MAX_GRAM + 1), 0)
    for r in each.groupBy("n", "level").count().orderBy(F.desc("level")).collect() if langs else []:
        sizes[r["n"]] += r["count"]
        if sizes[r["n"]] > entries:
            least[r["n"]] = max(least[r["n"]], r["level"] + 1)
    kept = each.filter(F.col("level") >= F.element_at(F.create_map(*[F.lit(x) for nl in least.items() for x in nl]), F.col("n"))).drop("all", "level") if langs else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([c.to_numpy() for c in b.columns[2:]], axis=1) if b.num_rows else np.zeros((0, len(langs)), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (b.column(0).to_numpy().tobytes(), b.column(1).to_numpy().tobytes(), counts.tobytes())], names=["n", "h", "c"])

    packed = kept.mapInArrow(pack, "n binary, h binary, c binary").collect() if langs else []
    order = np.concatenate([np.frombuffer(r["n"], np.int32) for r in packed] or [np.zeros(0, np.int32)])
    hashes = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in packed] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r["c"], np.float32).reshape(-1, len(langs)) for r in packed] or [np.zeros((0, 0), np.float32)])
    del packed
    forget(counted)
    tables = []
    for n in range(MAX_GRAM + 1):
        own = np.flatnonzero(order == n)
        own = own[np.argsort(hashes[own])]
        total = np.array([totals.get((lg, n), 0) for lg in langs]) + 0.5 * (sizes[n] + 1)
        tables.append((hashes[own], np.log((counts[own] + 0.5) / total).astype(np.float32)))
    return WordFirst(langs, tables)


def coverage_limit(docs: DataFrame, model: WordFirst, text: str = "text", words: int = 20) -> float:
    """The coverage under which a text is of none of the model's languages, from labelled rows that the model has not learned.

    LOW times that of the hundredth part of the texts of at least `words` words that lies lowest, exactly, of all rows. 0, so that
    nothing is turned away, if there are fewer than 20.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def cover(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(shared.value.read(s.tolist(), coverage=True)[2])
        shared.value._start()
        trim()

    got = stored(docs.select(text).dropna().filter(F.size(F.split(text, r"\s+")) >= words).select(cover(F.col(text)).alias("x")), BATCH)
    limit = LOW * order_statistics(got, ["x"], {"x": (0.01,)})["x"][0][1] if got.count() >= 20 else 0.0
    forget(got)
    shared.unpersist()
    return limit


def identify(docs: DataFrame, model: WordFirst, text: str = "text", coverage: bool = False) -> DataFrame:
    """Add lang_pred and score (0 to 1) for every whole text; columns of those names are replaced, all others stay.

    With `coverage` also that: the most that the text's share of the predicted language can be (see WordFirst.read()).

    A null text, or one without a letter, is 'und' with score 0; ties go to the first language by name. A word without
    any known n-gram says nothing for any language. Rows are independent: repeated rows get equal answers; long
    texts are read in parts; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, coverage double")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            langs, scores, most = shared.value.read(s.tolist(), coverage)
            yield pd.DataFrame({"lang": langs, "score": scores, "coverage": most}, index=s.index)
        shared.value._start()  # the remembered words
        trim()

    new = ("lang_pred", "score", "coverage")[: 2 + coverage]
    ask = ask.asNondeterministic()  # else a filter on what it says is pushed under it and every text is read twice, by two workers a task
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    said = [F.col(f"said.{c}").alias(n) for c, n in zip(("lang", "score", "coverage"), new)]
    return docs.select(row.alias("row"), ask(F.col(text)).alias("said")).select("row.*", *said)
