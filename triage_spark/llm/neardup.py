"""Near-duplicate classes: MinHash with tensored banding, then exact checks on full shingle sets.

How a table with many members is searched without all its pairs. One member, the pivot m, is held against each
other member x: with A the shingles of x that m lacks, R those of m that x lacks and d = |A| + |R|, x is near m if
d <= k (|x| + |m|), k = (100 - percent) / (100 + percent). Two members near m are linked through it. For any other
pair (x, y) that is to be linked, one of both, say x, is far from m, and |x ^ y| <= k (|x| + |y|) asks for shared
differences from m: of the added ones at least g = (|Ax| + |Ay| + ||Rx| - |Ry|| - k (|x| + |y|)) / 2. As |y| is |m| + |Ay| - |Ry|,
g >= (d_x + |y| - |m| - k (|x| + |y|)) / 2, which is above 0 unless y is smaller than m; then
h = (|Rx| + |Ry| + ||Ax| - |Ay|| - k (|x| + |y|)) / 2 > 0 removed ones are shared. So the pair shares an element among the first
|A| - g + 1 added ones of both (or the first |R| - h + 1 removed ones), in any one order: the rarest among the
members of m first. Removed elements are needed for small sets alone: a far x meets there only sets of at most its reach,
(|m| - d_x + k |x|) / (1 - k), which is less than |m|, as any larger partner shares an added element with it; two far ones meet
there if each is within the other's reach. So a member without any other of a fitting size leaves such a table.
These elements are the next, smaller tables, whose pivots are the members with the fewest
elements of their own, which are near most others. A next table of at most FULL members (GROWTH times as many with each
further pass) is compared in full, first by parity sketches, which differ in no more bits than the sets do in elements,
a larger one by a pivot again; so few passes are made, no link is lost, and a member
is compared with a number of others that grows far slower than its group. Of tables of the same members one is kept; one
whose members are all near its pivot is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage_spark.llm.common import BATCH, stored, trim
from triage_spark.llm.graph import connected_components

SHINGLE = 5
ROWS = 3  # minhashes of a collection; a table key is a pair of collections
MISS = 1e-3  # at most this share of the single pairs right at the threshold meets in no table
FULL, GROWTH = 64, 2  # members up to which a next table is compared in full, and how that grows from pass to pass
SKETCH = 8  # longs of a parity sketch, which bounds the difference of two sets from below
ANY = 1 << 62  # the reach of a member that may meet sets of any size
SLICE_BYTES = 1 << 20  # text that one vector step takes together

SEED = 20240501
_rng = np.random.default_rng(SEED)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
WORD_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def missed(likeness: float, collections: int) -> float:
    """The probability that a pair agrees in fewer than two collections, so that no table holds both."""
    q = likeness**ROWS
    return (1 - q) ** collections + collections * q * (1 - q) ** (collections - 1)


def collections_for(percent: int) -> int:
    """The fewest collections that miss at most MISS at the threshold: 11 (55 tables) at 85, 14 (91) at 80."""
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    n = 2
    while missed(percent / 100, n) > MISS:
        n += 1
    return n


def hash_functions(collections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    rng.integers(1, 1 << 63, 256, dtype=np.uint64)  # those of BYTE_VALUES
    a = rng.integers(1, 1 << 63, collections * ROWS, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 63, collections * ROWS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts, one after the other, and the number of each text's.

    Words are runs without white space, A-Z lower-cased. A text with fewer words than a shingle has one
    hash, of all its words; one without words has none. All steps are vectors over the joined bytes.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = SPACE[data]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    first = np.flatnonzero(edge == -1)
    last = np.flatnonzero(edge == 1)  # data ends with a space, so every word ends
    p = powers(MULTIPLIER, len(data) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[LOWER[data]] * p[:-1], dtype=np.uint64)])
    # the sum of a word's bytes times their powers, moved back to the power 0: comparable at any place
    words = mix((run[last] - run[first]) * powers(INVERSE, len(data) + 1)[first] + (last - first).astype(np.uint64))
    per_text = np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(texts))
    start = np.cumsum(per_text) - per_text
    size = np.minimum(per_text, SHINGLE)
    n = np.where(per_text > 0, per_text - size + 1, 0)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    width = np.repeat(size, n)
    out = width.astype(np.uint64)
    for j in range(SHINGLE):
        take = width > j
        out[take] = mix(out[take] * WORD_STEP + words[at[take] + j])
    return out, n


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE_BYTES, with the place of the first; a longer text stands alone."""
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def sets_of(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in slices(texts):
        h, n = shingle_hashes(part)
        for s in np.split(h, np.cumsum(n)[:-1]):
            s = np.sort(s)
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def minhashes(s: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over a set, folded to 32 bits."""
    out = np.empty(len(functions[0]), dtype=np.uint32)
    for k, (a, b) in enumerate(zip(*functions)):
        out[k] = np.min((s * a + b) >> np.uint64(32))
    return out


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two longs of a whole set, which stand for it."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s * MULTIPLIER)).view(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH longs: of each place a hash sends elements to, whether it gets an odd number. Sets that differ in d elements differ in d bits at most."""
    place = mix(s + MULTIPLIER) % np.uint64(64 * SKETCH)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, collections: int) -> DataFrame:
    """One row per row: key, content (hash of the text), n (set size), h1, h2 (of the whole set), collections (one long each)."""
    functions = hash_functions(collections)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, keys = [], [], [], []
            for s in sets_of(text_bytes(b.column(2))):
                n.append(len(s))
                if not len(s):
                    h1.append(None), h2.append(None), keys.append(None)
                    continue
                for to, h in zip((h1, h2), set_hashes(s)):
                    to.append(h)
                row = np.arange(collections, dtype=np.uint64)
                for part in minhashes(s, functions).reshape(collections, ROWS).T:
                    row = mix(row * WORD_STEP + part.astype(np.uint64))
                keys.append(row.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=names)
        trim()

    longs = ("content", "n", "h1", "h2")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("collections", T.ArrayType(T.LongType()))])
    names = schema.names
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("content"), F.col(text).alias("text")).mapInArrow(sign, schema)


def table_keys(reps: DataFrame, collections: int) -> DataFrame:
    """One row per node and table; tables are the pairs of collections."""
    pairs = [(i, j) for i in range(collections) for j in range(i + 1, collections)]
    keys = F.array(*[F.xxhash64(F.lit(i * collections + j), F.col("collections")[i], F.col("collections")[j]) for i, j in pairs])
    return reps.select("node", "n", F.explode(keys).alias("table_key"))


def stars(members: DataFrame) -> DataFrame:
    """(a, b): the pivot of each table and its other members, with n and weight of b and the least n that b meets.

    The pivot is the member of the greatest weight. `members`: table_key, node, n, weight.
    """
    pivots = stored(members.groupBy("table_key").agg(F.max(F.struct("weight", (-F.col("node")).alias("order"), "node")).alias("p"), F.min("n").alias("lo")))
    met = members.join(pivots, "table_key").filter("node <> p.node")
    return met.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.min("lo").alias("lo"), F.first("n").alias("n"), F.first("weight").alias("weight"))


def near_enough(a: str, b: str, percent: int) -> str:
    """Sets whose sizes alone rule the likeness out need no check."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def near_sketches(percent: int) -> str:
    """Sketches alone rule the likeness out where they differ in more bits than the sets may in elements."""
    bits = " + ".join(f"bit_count(p{k}_x ^ p{k}_y)" for k in range(SKETCH))
    return f"{100 + percent} * ({bits}) <= {100 - percent} * (n_x + n_y)"


def next_pairs(members: DataFrame, sets: DataFrame, percent: int, full: int) -> DataFrame:
    """The pairs to compare of the next tables: of those of at most `full` members all whose sketches allow a link (with a null lo), the stars of larger ones.

    Two members near the table's pivot are linked through it already.
    """
    bits = [f"p{k}" for k in range(SKETCH)]
    small = stored(members.filter(f"members <= {full}").select("table_key", "node", "n", "near", "reach").join(sets.select("node", *bits), "node"))
    x, y = (small.select("table_key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "near", "reach", *bits)]) for side in "xy")
    apart = f"node_x < node_y AND NOT (near_x AND near_y) AND n_x <= reach_y AND n_y <= reach_x AND {near_enough('n_x', 'n_y', percent)} AND {near_sketches(percent)}"
    every = x.join(y, "table_key").filter(apart).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    null = F.lit(None).cast("bigint")
    return stars(members.filter(f"members > {full}")).unionByName(every.select("a", "b", null.alias("lo"), null.alias("n"), null.alias("weight")))


def stored_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """node, s, p0, ...: the sorted shingle set, as bytes, and the sketch of each wanted node (node, key, n, h1, h2); one text of each is read again."""
    heads = wanted.select(F.col("key").alias("head__")).distinct()
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in sets_of(text_bytes(b.column(0))) if len(s)]
            h = np.array([set_hashes(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            p = np.array([sketch(s) for s in sets], dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, p.T.copy())], names=["h1", "h2", "s", *bits])
        trim()

    bits = [f"p{k}" for k in range(SKETCH)]

    sets = read.join(heads, F.col("key").eqNullSafe(F.col("head__")), "left_semi").select("text").mapInArrow(build, "h1 bigint, h2 bigint, s binary, " + ", ".join(f"{b} bigint" for b in bits))
    return sets.join(wanted, ["h1", "h2"]).filter(F.octet_length("s") == 8 * F.col("n")).groupBy("node").agg(*[F.first(c).alias(c) for c in ("s", *bits)])


def differences(m: np.ndarray, x: np.ndarray, least_size: int, percent: int) -> tuple[bool, np.ndarray, int, np.ndarray, int, int]:
    """Whether x is near the pivot m; its added elements and how many of them, in one order, hold one that a further
    link of x must share; the same of the removed elements (none where no link can rest on them alone); the largest set
    that x meets by removed elements.

    least_size: the smallest set that x may be linked with. See the head of this module.
    """
    more, less = 100 + percent, 100 - percent
    place = np.searchsorted(m, x)
    common = m[np.minimum(place, len(m) - 1)] == x
    added, both = x[~common], int(common.sum())
    d = len(x) + len(m) - 2 * both
    over = more * d - less * (len(x) + len(m))
    partner = max(least_size, -(-percent * len(x) // 100))
    reach = ANY if over <= 0 else (2 * percent * len(m) - over) // (2 * percent)
    if over <= 0:
        g, h, smaller = max(1, percent * (len(x) - len(m)) // more + 1), 1, len(x) < len(m)
    else:
        g = max(1, -(-(more * (d - len(m)) - less * len(x) + 2 * percent * partner) // (2 * more)))
        h, smaller = -(-over // (2 * more)), partner <= reach
    removed = m[:0]
    if smaller:
        gone = np.ones(len(m), dtype=bool)
        gone[place[common]] = False
        removed = m[gone]
    return over <= 0, added, max(0, len(added) - g + 1), removed, max(0, len(removed) - h + 1), reach


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, n, weight, near (100 * intersection >= percent * union of the full sets), added, keep, removed, keep_removed, reach.

    A pivot of very many members is a hot key of the joins, which Spark's skew join splits: both sides are plain tables.
    """

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, added, keep, removed, keep_removed, reach = [], [], [], [], [], []
            for lo, m, x in zip(b.column(4).to_pylist(), b.column(5), b.column(6)):
                found = differences(np.frombuffer(m.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64), lo or 0, percent)
                wanted = found if lo is not None and found[2] + found[4] else (found[0], found[1][:0], 0, found[3][:0], 0, found[5])
                for to, v in zip((near, added, keep, removed, keep_removed, reach), wanted):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near, pa.bool_()), lists(added), pa.array(keep, pa.int64()), lists(removed), pa.array(keep_removed, pa.int64()), pa.array(reach, pa.int64())], names=names)
        trim()

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    names = ["a", "b", "n", "weight", "near", "added", "keep", "removed", "keep_removed", "reach"]
    schema = "a bigint, b bigint, n bigint, weight bigint, near boolean, added array<bigint>, keep bigint, removed array<bigint>, keep_removed bigint, reach bigint"
    return joined.select("a", "b", "n", "weight", "lo", "sa", "sb").mapInArrow(check, schema)


def meeting(members: DataFrame, percent: int) -> DataFrame:
    """The members of tables of removed elements that have another to be compared with there: of a fitting size, each within the
    other's reach, not both near. Of a table its distinct set sizes are gathered, with the largest reach of each.
    """
    far = F.when(~F.col("near"), F.col("reach"))
    sizes = members.groupBy("table_key", F.col("n").alias("size")).agg(F.max("reach").alias("reach"), F.max(far).alias("far"))
    sizes = stored(sizes.groupBy("table_key").agg(F.collect_list(F.struct("size", "reach", "far")).alias("sizes")))
    fits = f"exists(sizes, s -> s.size <= reach AND n <= if(near, s.far, s.reach) AND {near_enough('n', 's.size', percent)})"
    return members.join(sizes, "table_key").filter(fits).drop("sizes")


def next_members(done: DataFrame, percent: int) -> DataFrame:
    """table_key, node, n, weight, near, reach, own, members: the next tables, one for each pivot and element that is shared.

    An element that no other member has (`own` counts the added ones) takes its place in the order, but makes no table.
    """
    own = ("a", F.col("b").alias("node"), "n", "weight", "near")
    added = done.select(*own, F.lit(ANY).alias("reach"), F.lit(0).alias("kind"), F.explode("added").alias("element"), "keep", F.size("added").alias("all"))
    removed = done.select(*own, "reach", F.lit(1).alias("kind"), F.explode("removed").alias("element"), F.col("keep_removed").alias("keep"), F.size("removed").alias("all"))
    each = added.unionByName(removed).withColumn("table_key", F.xxhash64("a", "kind", "element")).drop("element")
    shared = stored(each.groupBy("table_key").agg(F.count("*").alias("have")).filter("have > 1"))
    w = Window.partitionBy("a", "node", "kind")
    ranked = each.join(shared, "table_key").withColumn("common", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("have", "table_key")))
    own = F.when(F.col("kind") == 0, F.col("all") - F.col("common")).alias("own")
    first = stored(ranked.filter("place <= keep - (all - common)").select("table_key", "kind", "node", "n", "weight", "near", "reach", own))
    first = stored(first.filter("kind = 0").unionByName(meeting(first.filter("kind = 1"), percent)).drop("kind"))
    same = [F.bit_xor(F.xxhash64("node", "reach", F.lit(k))).alias(f"same{k}") for k in (0, 1)]  # equal for tables of the same members
    open_ = first.groupBy("table_key").agg(F.count("*").alias("members"), F.every("near").alias("all_near"), *same).filter("members > 1 AND NOT all_near")
    open_ = stored(open_.groupBy("members", "same0", "same1").agg(F.min("table_key").alias("table_key")).select("table_key", "members"))
    return first.join(open_, "table_key")


def linked(classes: DataFrame, collections: int, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """node, component of all sets that are linked with another one."""
    keys = table_keys(classes, collections)
    tables = stored(keys.groupBy("table_key").agg(F.count("*").alias("members")).filter("members > 1"))
    members = stored(keys.join(tables, "table_key"))
    weights = members.groupBy("node").agg(F.sum("members").alias("weight"))
    pairs = stored(stars(members.drop("members").join(weights, "node")))
    wanted = classes.join(weights.select("node"), "node", "left_semi").select("node", F.col("head.key").alias("key"), "n", "h1", "h2")
    sets = stored(stored_sets(wanted, docs, key, text))
    links = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    full = FULL
    while not pairs.isEmpty():
        done = stored(verify(pairs, sets, percent))
        links = links.unionByName(done.filter("near").select("a", "b"))
        members = stored(next_members(done, percent))
        if full == FULL:  # from here on the order of the pivots: it must stay, so that the search ends
            own = members.groupBy("node").agg((-F.min("own")).alias("weight"))
            members = stored(members.drop("weight").join(own, "node"))
        pairs = stored(next_pairs(members, sets, percent, full))
        full *= GROWTH
    return connected_components(links)


def row_classes(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, content, n, head (unknown, key, row: of the first row of its class), row."""
    collections = collections_for(percent)
    signed = stored(signatures(docs, key, text, collections).withColumn("row", F.monotonically_increasing_id()), BATCH)
    head = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row")).alias("head")
    classes = signed.filter("n > 0").groupBy("h1", "h2", "n").agg(head, F.first("collections").alias("collections"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    found = linked(classes, collections, docs, key, text, percent)
    named = classes.select("node", "h1", "h2", "n", "head").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = stored(named.groupBy("component").agg(F.min("head").alias("first")))
    known = named.join(heads, "component").select("h1", "h2", "n", "first")
    out = signed.select("key", "content", "row", "n", "h1", "h2").join(known, ["h1", "h2", "n"], "left")
    own = F.struct(F.col("key").isNull().alias("unknown"), "key", "row")
    return out.select("key", "content", "row", "n", F.coalesce("first", own).alias("head"))


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links, itself included), kept: one row per row.

    Texts of one shingle set are one node. Nodes that agree in a table (a pair of collections of minhashes) are
    compared by pivots (see the head of this module); every link is confirmed on the full sets.
    `kept` holds for one row of each class, that of the smallest key (for unique keys: key = component_id); of rows
    that repeat it, for one. Null keys come last: a class of such rows alone has a null component_id.
    Rows without words (or a null text) are linked with nothing and kept. Keys may be of any type with an order;
    long texts are whole sets; other columns are not read, whatever their names; an empty table gives no rows.
    """
    rows = row_classes(docs, percent, key, text)
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("head.key").alias("component_id"), (F.col("head.row") == F.col("row")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without all but one of each near-duplicate class (as `kept` says).

    Rows are told apart by key and text, so a row goes or stays whatever others share its key; of
    rows equal in both, one stays.
    """
    rows = row_classes(docs, percent, key, text)
    groups = rows.groupBy("key", "content").agg(F.count("*").alias("rows"), F.max((F.col("head.row") == F.col("row")).cast("int")).alias("kept"))
    changed = stored(groups.filter("rows > 1 OR kept = 0").select(F.col("key").alias("key__"), F.col("content").alias("content__"), "kept"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("content"))  # no column of docs can clash
    same = F.col("key").eqNullSafe(F.col("key__")) & (F.col("content") == F.col("content__"))
    stay = own.join(changed, same, "left_anti")
    again = own.join(changed.filter("kept = 1"), same, "left_semi").dropDuplicates(["key", "content"])
    return stay.unionByName(again).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
