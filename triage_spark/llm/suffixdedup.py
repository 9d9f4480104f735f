"""Repeated byte strings: suffix buckets, each sorted on its own by the ranks of a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage_spark.llm.common import forget, stored

LENGTH = 200
GRAM = 32  # bytes whose hash names a bucket
CHUNK = 1 << 20  # bytes that are hashed together
SIDE = 8
PERIOD = SIDE * SIDE  # of the difference cover: 0 to 7 and the multiples of 8 differ by every residue
COVER = sorted({*range(SIDE), *range(0, PERIOD, SIDE)})
BLOCK = 2 << 20  # bytes of segments that one sort takes, and what is left of the last bucket
WIDEST = 4096  # classes that one sorted bucket holds; larger ones are split by where in them a string begins
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of hashes, in order."""
    out = a * MIX
    out ^= out >> np.uint64(29)
    out += b
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def window_hashes(data: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Hashes of all windows of 1, 2, 4 ... `width` bytes that begin at each place and end inside."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    out, n = {1: h}, 1
    while 2 * n <= width and len(h) > n:
        h = mixed(h[:-n], h[n:])
        n *= 2
        out[n] = h
    return out


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of each `width` neighbours: running minima from both ends of blocks."""
    n = len(key) - width + 1
    pad = -len(key) % width
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts of one stretch of texts: (bucket, hash, first start, last start, place of the gram), by place.

    Every string of `length` bytes holds one place whose GRAM bytes hash lowest, the leftmost of equals; that hash
    is its bucket, so that equal strings share a bucket and lie in it at the same distance from that place. Starts
    in a row with one such place make a context: the bytes from its first start to the end of its last string.
    ends: where each text ends; strings do not cross them.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if len(data) < length:
        return none
    hashes = window_hashes(data, 128)
    gram = hashes[GRAM]
    key = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    place = (sliding_min(key, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(place)]
    inside = start + length <= ends[text]
    place, start = place[inside], start[inside]
    if not len(place):
        return none
    cut = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    first, last, place = start[cut], start[np.append(cut[1:], len(start)) - 1], place[cut]
    stop = last + length
    whole = hashes[128]
    mark = mixed(mixed(mixed(whole[first], whole[np.minimum(first + 128, stop - 128)]), whole[stop - 128]), (stop - first).astype(np.uint64))
    return gram[place], mark, first, last, place


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


OCCURRENCE = "rid bigint, rid2 int, bucket bigint, mark bigint, first int, last int, place int"


def find_contexts(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(bytes(h[3]) for h in held), np.uint8)
            lengths = np.array([len(h[3]) for h in held])
            ends = np.cumsum(lengths)
            bucket, mark, first, last, place = contexts(data, ends, length)
            at = np.searchsorted(ends, first, "right")
            shift = np.array([h[2] for h in held], np.int64)[at] - (ends - lengths)[at]
            ints = [pa.array((x + shift).astype(np.int32)) for x in (first, last, place)]
            rid, rid2 = np.array([h[0] for h in held], np.int64)[at], np.array([h[1] for h in held], np.int32)[at]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rid2), as_long(bucket), as_long(mark), *ints], names=["rid", "rid2", "bucket", "mark", "first", "last", "place"])

        for b in batches:
            for rid, rid2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                body = t.as_buffer()
                body = memoryview(body) if body is not None else memoryview(b"")
                for at in range(0, max(len(body) - length + 1, 0), CHUNK):  # a long text in parts that share length - 1 bytes
                    part = body[at : at + CHUNK + length - 1]
                    held.append((rid, rid2, at, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return find


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows by the given keys, the first key leading; equal rows get equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def sort_suffixes(segments: list[bytes], anchors: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of `segments` that begin a string of `length` bytes, and whether their string begins elsewhere too.

    segments: whole contexts; anchors: the place of the gram in each; counts[k] suffixes of each, from its first
    byte on. The segments are laid out with all grams at a multiple of PERIOD. The suffixes at places of the difference cover
    are ranked first, by 64 bytes and then by doubling. Any two suffixes whose strings may be equal begin at the
    same distance from a gram, so at most SIDE - 1 bytes on both meet the cover: these bytes and the rank there
    order them. Neighbours in this order are equal over `length` bytes where their first bytes, their ranks over
    128 and 64 bytes and the few bytes left are. Returns segment, distance to the gram, twin.
    """
    sizes = np.array([len(s) for s in segments])
    lead = -anchors % PERIOD  # bytes before a segment
    room = (lead + sizes + 2 * PERIOD) // PERIOD * PERIOD + length // PERIOD * PERIOD + PERIOD
    begin = np.cumsum(room) - room + lead
    data = np.zeros(int(room.sum()) + 8 * PERIOD, np.uint8)
    for s, at in zip(segments, begin.tolist()):
        data[at : at + len(s)] = np.frombuffer(s, np.uint8)
    words = np.zeros(len(data) - 7, np.uint64)  # eight bytes from each place on, the first the most significant
    for k in range(8):
        words = (words << np.uint64(8)) | data[k : len(data) - 7 + k].astype(np.uint64)
    grid = np.arange(0, int(room.sum()), PERIOD)
    cover = (grid[:, None] + np.array(COVER)[None, :]).ravel()
    place_of = np.full(len(data), -1, np.int64)
    place_of[cover] = np.arange(len(cover))
    r64 = dense(*(words[cover + 8 * k] for k in range(PERIOD // 8)))

    def twice(r: np.ndarray, step: int) -> np.ndarray:
        at = cover + step
        ahead = np.where(at < int(room.sum()), place_of[np.minimum(at, len(data) - 1)], -1)
        return dense(r, np.where(ahead >= 0, r[ahead], 0))

    r128 = twice(r64, 64)
    r256 = twice(r128, 128)
    segment = np.repeat(np.arange(len(segments)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + begin[segment]
    distance = begin[segment] + anchors[segment] - start
    shift = -start % SIDE  # to the next multiple of SIDE, which is in the cover
    sample = place_of[start + shift]
    head = words[start] >> (np.uint64(8) * (np.uint64(8) - shift.astype(np.uint64))) if len(start) else np.zeros(0, np.uint64)
    head = np.where(shift == 0, np.uint64(0), head)
    rest = length - shift - 192  # bytes after the two ranked stretches
    tail = words[start + shift + 192] >> (np.uint64(8) * (np.uint64(8) - np.minimum(rest, 8).astype(np.uint64)))
    tail = np.where(rest == 8, words[start + shift + 192], tail)
    order = np.lexsort((r256[sample], head, distance))
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in (distance, head, r128[sample], r64[place_of[start + shift + 128]], tail):
        s = k[order]
        same &= s[1:] == s[:-1]
    twin = np.zeros(len(order), bool)
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    return segment, distance, twin


def spans_of(segment: np.ndarray, distance: np.ndarray, twin: np.ndarray, n: int) -> list[list[int]]:
    """For each segment the distances of its twins to the gram, as pairs: farthest, nearest."""
    out: list[list[int]] = [[] for _ in range(n)]
    seg, dist = segment[twin], distance[twin]
    if len(seg):
        new = np.flatnonzero((np.diff(seg, prepend=-1) != 0) | (np.diff(dist, prepend=dist[0] + 2) != -1))
        for s, far, near in zip(seg[new].tolist(), dist[new].tolist(), dist[np.append(new[1:], len(dist)) - 1].tolist()):
            out[s] += [far, near]
    return out


def sort_buckets(length: int):
    """Rows (bucket, mark, anchor, width, segment), sorted by bucket, to (bucket, mark, spans); blocks end with a bucket."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, int, bytes]] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            names, rows = list(held), list(held.values())
            # grams of different buckets differ, so their strings do, and all buckets of a block share one sort
            segment, distance, twin = sort_suffixes([r[2] for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), length)
            found = spans_of(*by_segment(segment, distance, twin), len(rows))
            keep = [k for k, f in enumerate(found) if f]
            out = [pa.array([names[k][0] for k in keep], pa.int64()), pa.array([names[k][1] for k in keep], pa.int64()), pa.array([found[k] for k in keep], pa.list_(pa.int32()))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["bucket", "mark", "spans"])

        for b in batches:
            for bucket, mark, anchor, width, body in zip(*(b.column(k).to_pylist() for k in range(5))):
                if size >= BLOCK and bucket != last:
                    yield flush()
                    size = 0
                last = bucket
                if (bucket, mark) not in held:
                    held[bucket, mark] = anchor, width, body
                    size += len(body)
        if held:
            yield flush()

    return sort


def by_segment(segment: np.ndarray, distance: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((-distance, segment))
    return segment[order], distance[order], twin[order]


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, rid2, list of first and last byte of spans) to sorted spans that do not touch."""
    for b in batches:
        out = []
        for found in b.column(2).to_pylist():
            merged: list[int] = []
            for start, stop in sorted(zip(found[::2], found[1::2])):
                if merged and start <= merged[-1]:
                    merged[-1] = max(merged[-1], stop)
                else:
                    merged += [start, stop]
            out.append(merged)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["rid", "rid2", "spans"])


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows by 96 bits of hash of key and text, with the text's bytes: rows equal in both have equal results."""
    return docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.hash(F.col(text), F.col(key)).alias("rid2"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("body"), F.col(key).alias("key"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, rid2 and spans (start and end of each in turn, sorted, not touching) of bytes in a `length`-byte string that begins elsewhere too.

    The suffix array is built bucket by bucket: equal strings share a bucket (contexts()), and suffixes in a bucket of
    one context never match. Contexts that are equal as a whole are one class, all of whose strings repeat; only
    buckets of several classes, one of them single, are sorted (sort_suffixes()), in blocks that bound the memory. A
    bucket of more than WIDEST classes is dealt by its single strings, as counts of their hashes. Very common
    classes are counted before they are moved.
    """
    if length != LENGTH:
        raise ValueError(f"the ranked stretches are laid out for strings of {LENGTH} bytes")
    rows = named(docs, key, text)
    found = stored(rows.filter(F.length("body") >= length).select("rid", "rid2", "body").mapInArrow(find_contexts(length), OCCURRENCE))
    shared = stored(found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    repeated = stored(found.join(shared, "bucket", "left_semi"))
    forget(found)
    classes = stored(repeated.groupBy("bucket", "mark").agg(F.count("*").alias("n"), F.min(F.struct("rid", "rid2", "first", "last", "place")).alias("at")))
    wide = stored(classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 AND least = 1").drop("least"))
    due = classes.join(wide, "bucket").select("bucket", "mark", "classes", "at.*")
    bodies = due.join(rows.select("rid", "rid2", "body"), ["rid", "rid2"]).withColumn("segment", F.expr(f"substring(body, first + 1, last - first + {length})"))
    due = stored(bodies.select("bucket", "mark", "classes", (F.col("place") - F.col("first")).alias("anchor"), (F.col("last") - F.col("first") + 1).alias("width"), "segment"))
    part = due.filter(F.col("classes") <= WIDEST).select("bucket", "mark", "anchor", "width", "segment").repartition("bucket").sortWithinPartitions("bucket")
    twins = stored(part.mapInArrow(sort_buckets(length), "bucket bigint, mark bigint, spans array<int>"))
    strings = due.filter(F.col("classes") > WIDEST).dropDuplicates(["bucket", "mark"]).select("bucket", "mark", "anchor", F.posexplode(F.expr(f"transform(sequence(0, width - 1), k -> substring(segment, k + 1, {length}))")).alias("k", "string"))
    strings = stored(strings.select("bucket", "mark", (F.col("anchor") - F.col("k")).alias("distance"), F.xxhash64("string").alias("h"), F.xxhash64("string", F.lit(1)).alias("h2")))
    name = ["bucket", "distance", "h", "h2"]
    again = stored(strings.groupBy(*name).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    more = strings.join(again, name).groupBy("bucket", "mark").agg(F.flatten(F.collect_list(F.array("distance", "distance"))).alias("spans"))
    whole = classes.filter("n > 1").select("bucket", "mark", F.expr("array(at.place - at.first, at.place - at.last)").alias("spans"))
    single = twins.unionByName(more).join(classes.filter("n = 1").select("bucket", "mark"), ["bucket", "mark"], "left_semi")
    decided = stored(whole.unionByName(single))
    pairs = f"transform(spans, (d, k) -> if(k % 2 = 0, place - d, place - d + {length}))"
    covered = repeated.join(decided, ["bucket", "mark"]).select("rid", "rid2", F.expr(pairs).alias("spans"))
    return stored(covered.groupBy("rid", "rid2").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(merge, "rid bigint, rid2 int, spans array<int>"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes, spans and kept: each text's bytes without those of strings of `length` bytes that begin elsewhere too.

    Texts are UTF-8; strings do not cross texts and are judged on the input, so all copies go, the first too. Null and
    empty texts have no bytes, shorter ones than `length` lose none; rows equal in key and text count as two
    places each, null keys are keys as any other; other columns are not read, whatever their names; very long texts
    are hashed in parts; an empty table gives no rows. spans are the removed ones, start and end in turn.
    """
    rows, spans = named(docs, key, text), repeated_spans(docs, length, key, text)
    kind = docs.schema[key].dataType
    both = rows.join(spans, ["rid", "rid2"], "left").select("key", "body", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed = [], []
            for body, found in zip(b.column(1), b.column(2).to_pylist()):
                body, found = memoryview(body.as_buffer()), found or []
                kept.append(b"".join(body[a:z] for a, z in zip([0, *found[1::2]], [*found[::2], len(body)])))
                removed.append(found)
            sizes = pa.array([len(body.as_buffer()) for body in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("kept", T.BinaryType())])
    return both.mapInArrow(cut, schema)
