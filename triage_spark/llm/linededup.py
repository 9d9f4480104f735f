"""Repeated runs of lines: a suffix array over line numbers, built by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triage_spark.llm.common import BATCH, forget, prefix_sums, stored, trim

MIN_WORDS = 30


def row_id(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text))


def lines_of(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """sid, doc, pos, line and line2 (128 bits of hash of the stripped line), needs: lines of the windows that begin here.

    A window is the shortest run of min_words words from a line on, or back from a line; together they cover every
    run of min_words words or more, both its ends too. needs is null where none begins. Lines end at \\n; blank ones
    are lines of no words.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, doc, pos, line, line2, needs = [], [], [], [], [], []
            for s, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                parts = (t.as_py() or "").split("\n")
                words = [len(p.split()) for p in parts]
                own = [None] * len(parts)
                end = have = 0
                for k, p in enumerate(parts):
                    while have < min_words and end < len(parts):
                        have += words[end]
                        end += 1
                    if have >= min_words:
                        own[k] = [end - k]
                    have -= words[k]
                    h = xxhash.xxh3_128_intdigest(p.strip())
                    line.append((h >> 64) - (1 << 63))
                    line2.append((h & (1 << 64) - 1) - (1 << 63))
                begin = have = 0
                for k, n in enumerate(words):
                    have += n
                    while have - words[begin] >= min_words and begin < k:
                        have -= words[begin]
                        begin += 1
                    if have >= min_words and own[begin][0] != k + 1 - begin:
                        own[begin].append(k + 1 - begin)
                needs += own
                sid += [s] * len(parts)
                doc += [d] * len(parts)
                pos += range(len(parts))
            for at in range(0, len(pos), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[part], pa.int64()), pa.array(doc[part], b.schema.field(1).type), pa.array(pos[part], pa.int32()), pa.array(line[part], pa.int64()), pa.array(line2[part], pa.int64()), pa.array(needs[part], pa.list_(pa.int32()))],
                    names=["sid", "doc", "pos", "line", "line2", "needs"],
                )
        trim()

    rows = docs.select(row_id(key, text).alias("sid"), F.col(key).alias("doc"), text)
    return rows.mapInArrow(cut, f"sid bigint, doc {docs.schema[key].dataType.simpleString()}, pos int, line bigint, line2 bigint, needs array<int>")


PLACE = ("doc", "sid", "pos")


def ranks_of(groups: DataFrame, order: list[str]) -> DataFrame:
    """Groups of equal runs with `rank`: where the group begins in the suffix array."""
    return prefix_sums(groups, order, ["members"]).withColumnRenamed("members_before", "rank").drop("rows_before", "members")


def next_level(now: DataFrame, size: int) -> DataFrame:
    """Ranks of runs of 2 * size lines from those of `size` lines; suffixes whose run is unique leave."""
    second = now.select("sid", (F.col("pos") - size).alias("pos"), F.col("rank").alias("next"))
    pairs = now.join(second, ["sid", "pos"]).withColumnRenamed("rank", "head")
    groups = pairs.groupBy("head", "next").agg(F.count("*").alias("members")).filter("members > 1")
    return stored(pairs.join(ranks_of(groups, ["head", "next"]), ["head", "next"]).drop("head", "next"))


def held_whole(levels: list[DataFrame], spans: DataFrame) -> DataFrame:
    """Of spans (sid, doc, pos, stop) those that an earlier place holds whole, with `first`, that place.

    levels[k] has the ranks of runs of 2^k lines. A span of 2^k to 2^(k+1) - 1 lines is fixed by the run that begins it and the
    one that ends it; whoever has both at the same distance holds it. Only places that share the first run are looked at, for the
    lengths asked there; all levels go together.
    """
    ranks = levels[0].select(F.lit(0).alias("level"), "sid", "doc", "pos", "rank")
    for k, now in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(now.select(F.lit(k).alias("level"), "sid", "doc", "pos", "rank"))
    tail = ranks.select("level", "sid", F.expr("pos + shiftleft(1, level)").alias("stop"), F.col("rank").alias("tail"))
    need = F.col("stop") - F.col("pos")
    spans = spans.withColumn("need", need).withColumn("level", (F.length(F.bin("need")) - 1).cast("int"))
    asked = stored(spans.join(ranks.drop("doc"), ["level", "sid", "pos"]).join(tail, ["level", "sid", "stop"]))
    lengths = stored(asked.select("level", "rank", "need").distinct())
    places = ranks.join(lengths, ["level", "rank"]).withColumn("stop", F.col("pos") + F.col("need")).join(tail, ["level", "sid", "stop"])
    interval = ["level", "need", "rank", "tail"]
    firsts = stored(places.groupBy(*interval).agg(F.min(F.struct(*PLACE)).alias("first")))
    return stored(asked.join(firsts, interval).filter(F.col("first") != F.struct(*PLACE)).select("sid", "doc", "pos", "stop", "first"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """Runs of lines, of at least min_words words, that an earlier place has already; together they cover all such lines.

    Earlier means a smaller (key, row, line). The rank of a suffix by its first 2^k lines comes from sorting
    the pairs of ranks of its first and second 2^(k-1) lines; suffixes whose run is unique leave at once. The
    suffixes that agree in the rank of their first 2^k lines and of the 2^k lines that end a window of
    min_words words form an interval of the suffix array whose common prefix is at least that window; all but its
    first member are later copies. Windows are taken from every line on and back from every line, so that a run is
    covered up to both its ends. Windows of a text that overlap or touch make a stretch. With `whole`, doubling goes on to
    the longest stretch, and a stretch of which one earlier place holds every line in a row is one run, whatever places
    its windows were found at. Any other stretch, and all without `whole`, is cut by source: windows in step with one place are one run,
    which stands there whole at first_key and first_line; runs of different sources may then touch or overlap.

    Returns sid (hash of key and text), key, line_start, line_end (exclusive), first_key, first_line. A run may
    repeat within one text; of equal windows the smallest place comes first. Null and short texts have no runs;
    rows equal in key and text count once; an empty table gives no rows. Very long texts are lines like all
    others, and blank lines count as lines of no words. Only key and text are read; the key may not bear the name
    of another column returned. Lines are equal by 128 bits of hash: at 10^12 different lines a false match has a chance of 10^-15.
    """
    if key in ("sid", "line_start", "line_end", "first_key", "first_line"):
        raise ValueError(f"a key named {key} clashes with a column that is returned")
    kind = docs.schema[key].dataType.simpleString()
    lines = stored(lines_of(docs, key, text, min_words), BATCH)  # read twice; small Arrow batches: a worker holds few texts at a time
    line = ["line", "line2"]
    counts = lines.groupBy(*line).agg(F.count("*").alias("members")).filter("members > 1")
    # ranks and firsts are written out before their joins, so that Spark can split the joins of very common lines
    now = stored(lines.join(stored(ranks_of(counts, line)), line).drop(*line).dropDuplicates(["sid", "pos"]))
    forget(lines)
    most = now.agg(F.max(F.array_max("needs"))).first()[0] or 0
    found, k, levels = [], 0, [now]
    while (1 << k) <= most:
        size = 1 << k
        due = now.select("sid", "doc", "pos", "rank", F.explode(F.filter("needs", lambda n: (n >= size) & (n < 2 * size))).alias("need"))
        tail = now.select("sid", (F.col("pos") + size).alias("stop"), F.col("rank").alias("tail"))
        runs = due.withColumn("stop", F.col("pos") + F.col("need")).join(tail, ["sid", "stop"])
        interval = ["need", "rank", "tail"]
        firsts = stored(runs.groupBy(*interval).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("members")).filter("members > 1").drop("members"))
        later = runs.join(firsts, interval).filter(F.col("first") != F.struct(*PLACE))
        found.append(stored(later.select("sid", "doc", "pos", "stop", "first")))
        if 2 * size > most:
            break
        now = next_level(now, size)
        levels.append(now)
        k += 1
    spark = docs.sparkSession
    schema = f"sid bigint, {key} {kind}, line_start int, line_end int, first_key {kind}, first_line int"
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    own = Window.partitionBy("sid").orderBy("pos", "stop")
    apart = F.coalesce((F.col("pos") > F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    every = every.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(own)).drop("apart").withColumn("step", F.col("first.pos") - F.col("pos"))
    w = Window.partitionBy("sid", "first.sid", "step").orderBy("pos", "stop")
    fresh = F.coalesce((F.col("pos") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    marked = every.withColumn("run", fresh).withColumn("run", F.sum("run").over(w))
    merged = marked.groupBy("sid", "stretch", F.col("first.sid").alias("source"), "step", "run").agg(F.min("doc").alias("doc"), F.min("pos").alias("pos"), F.max("stop").alias("stop"), F.min("first").alias("first"))
    if whole:
        merged = stored(merged)
        parts = merged.groupBy("sid", "stretch").agg(F.min("doc").alias("doc"), F.min("pos").alias("pos"), F.max("stop").alias("stop"), F.count("*").alias("runs")).filter("runs > 1")
        parts = stored(parts)
        longest = parts.agg(F.max(F.col("stop") - F.col("pos"))).first()[0] or 0
        while longest >> len(levels):
            levels.append(next_level(levels[-1], 1 << len(levels) - 1))
        if longest:
            ones = held_whole(levels[: longest.bit_length()], parts.select("sid", "doc", "pos", "stop"))
            covered = ones.join(parts.select("sid", "pos", "stop", "stretch"), ["sid", "pos", "stop"]).select("sid", "stretch")
            merged = merged.join(covered, ["sid", "stretch"], "left_anti").select("sid", "doc", "pos", "stop", "first").unionByName(ones)
    return merged.select("sid", F.col("doc").alias(key), F.col("pos").alias("line_start"), F.col("stop").alias("line_end"), F.col("first.doc").alias("first_key"), F.col("first.pos").alias("first_line"))


def remove_runs(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the lines of `runs`; `removed_lines` says how many went (an existing column of that name is replaced).

    All other columns stay, whatever their names; rows without a run, null texts too, are as they were.
    """
    spans = runs.groupBy("sid").agg(F.collect_list(F.struct("line_start", "line_end")).alias("spans"))
    columns = [c for c in docs.columns if c != "removed_lines"]
    own = docs.select(row_id(key, text).alias("sid"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("whole"))
    lines = "filter(split(whole, '\\n'), (l, i) -> NOT exists(spans, s -> i >= s.line_start AND i < s.line_end))"
    d = own.join(spans, "sid", "left").withColumn("left", F.when(F.col("spans").isNotNull(), F.expr(lines)))
    gone = F.coalesce(F.size(F.split("whole", "\n")) - F.size("left"), F.lit(0))
    cut = F.when(F.col("left").isNull(), F.col("whole")).otherwise(F.array_join("left", "\n"))
    return d.select(*[cut.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns], F.when(F.col("left").isNull(), 0).otherwise(gone).alias("removed_lines"))
