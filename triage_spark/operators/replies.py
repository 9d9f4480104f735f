"""Requests and replies in batch: numbering, accounting, rates, timing, cross checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PIECES = 128  # ranges into which a column's values are cut


def piece_of(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at or below x: a balanced tree of comparisons, so a few for a row."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def cuts_of(df: DataFrame, x: Column, pieces: int = PIECES) -> list:
    """Values that cut a column into about equal pieces; equal values are never parted."""
    return sorted(set(df.select(F.percentile_approx(x, [i / pieces for i in range(1, pieces)], 100 * pieces)).first()[0] or []))


def before_in_stream(df: DataFrame, stream: str, order: list[str], value: str, out: str, pieces: int = PIECES) -> DataFrame:
    """df with `out`: `value` of the row before in its stream, by `order`; null for a stream's first row.

    A window covers one piece of one stream, so a stream that holds most rows is many windows; the last value of each
    piece is carried to the next piece of the stream that has rows.
    """
    d = df.withColumn("piece__", piece_of(F.col(order[0]), cuts_of(df, F.col(order[0]), pieces)))
    last = d.groupBy(stream, "piece__").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last__"))
    carried = last.select(stream, "piece__", F.lag("last__").over(Window.partitionBy(stream).orderBy("piece__")).alias("carried__"))  # at most `pieces` rows a stream
    own = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(stream, "piece__").orderBy(*order))
    both = d.withColumn("own__", own).join(carried, [stream, "piece__"])
    return both.withColumn(out, F.coalesce("own__", "carried__")["v"]).drop("piece__", "own__", "carried__")


def stream_quantiles(df: DataFrame, stream: str, value: str, shares: dict[str, float], pieces: int = PIECES) -> DataFrame:
    """stream and, by name, exact interpolated quantiles of `value` in each stream; streams without a value have no row.

    Counts by stream and range of values place the wanted ranks; only the ranges that hold one are numbered, each on its own.
    """
    v = df.filter(F.col(value).isNotNull()).select(stream, F.col(value).cast("double").alias("x__"))
    v = v.withColumn("piece__", piece_of(F.col("x__"), cuts_of(v, F.col("x__"), pieces)))
    w = Window.partitionBy(stream).orderBy("piece__").rowsBetween(Window.unboundedPreceding, -1)  # at most `pieces` rows a stream
    counts = v.groupBy(stream, "piece__").agg(F.count("*").alias("n"))
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(stream)))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("total") - 1)).alias("t")) for k, p in shares.items()])).alias("r")
    wanted = placed.select(stream, "piece__", "n", "before", ranks).select(stream, "piece__", "n", "before", "r.*", F.explode(F.array_distinct(F.array(F.floor("r.t"), F.ceil("r.t")))).alias("rank"))
    wanted = wanted.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(stream, "piece__", "before", "name", "t", "rank")
    held = v.join(wanted.select(stream, "piece__", "before").distinct(), [stream, "piece__"])
    numbered = held.withColumn("rank", F.row_number().over(Window.partitionBy(stream, "piece__").orderBy("x__")) - 1 + F.col("before")).drop("before")
    found = numbered.join(wanted.drop("before"), [stream, "piece__", "rank"])
    weight = F.when(F.floor("t") == F.ceil("t"), F.lit(1.0)).when(F.col("rank") == F.floor("t"), F.ceil("t") - F.col("t")).otherwise(F.col("t") - F.floor("t"))
    return found.groupBy(stream).agg(*[F.sum(F.when(F.col("name") == k, weight * F.col("x__"))).alias(k) for k in shares])


def batch_requests(df: DataFrame, size: int = 32, start: int = 0, key: str = "variant_key", payload: str = "score", streams: str | None = None, buckets: int | None = None) -> DataFrame:
    """batch, first_sequence, rows (array<struct<sequence, key, payload>>): rows numbered in the order of their keys, text keys in that of their hashes; `size` a batch.

    Numbers come from two levels: counts of ranges are added up (a few rows), then rows are numbered inside their
    range, so no window spans the table. There are as many ranges as shuffle partitions, PIECES at least.
    """
    order = F.xxhash64(key) if df.schema[key].dataType.simpleString() == "string" else F.col(key)
    buckets = buckets or max(PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("b__", piece_of(order, cuts_of(df, order, buckets)))
    w = Window.orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    before = d.groupBy("b__").agg(F.count("*").alias("n")).select("b__", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before__"))
    numbered = d.join(F.broadcast(before), "b__").withColumn("sequence", F.row_number().over(Window.partitionBy("b__").orderBy(order, key)) + F.col("before__") - 1 + start)
    packed = numbered.withColumn("batch", F.floor((F.col("sequence") - start) / size).cast("bigint"))
    return packed.groupBy("batch").agg(F.min("sequence").alias("first_sequence"), F.sort_array(F.collect_list(F.struct("sequence", key, payload))).alias("rows"))


def expected_flags(score: Column, threshold: int) -> tuple[Column, Column]:
    return (score >= 0).cast("int"), (score >= threshold).cast("int")


def judged_replies(expected: DataFrame, replies: DataFrame, threshold: int, stream: str = "stream_id") -> DataFrame:
    """Replies with known (asked for), first (first arrival of its sequence) and correct."""
    e = expected.select(stream, "sequence", F.col("score").alias("expected_score"))
    cls, deep = expected_flags(F.col("expected_score"), threshold)
    d = replies.join(e, [stream, "sequence"], "left").withColumn("known", F.col("expected_score").isNotNull())
    right = (F.col("score") == F.col("expected_score")) & (F.col("classification") == cls) & (F.col("deep_review") == deep)
    w = Window.partitionBy(stream, "sequence").orderBy("arrival", "reply_id")
    return d.withColumn("first", F.col("known") & (F.row_number().over(w) == 1)).withColumn("correct", F.col("known") & F.coalesce(right, F.lit(False)))


def reply_summary(expected: DataFrame, replies: DataFrame, threshold: int, stream: str = "stream_id") -> DataFrame:
    """Per stream: requested, received_unique, correct_unique, missing, duplicates, out_of_order, unrelated, mismatches.

    Out of order: a first arrival whose sequence is below that of the first arrival before it. A sequence counts
    as correct if any of its replies was; every wrong reply is a mismatch.
    """
    j = judged_replies(expected, replies, threshold, stream)
    back = before_in_stream(j.filter("first"), stream, ["arrival", "reply_id"], "sequence", "before")
    order = back.groupBy(stream).agg(F.count_if(F.col("sequence") < F.col("before")).alias("out_of_order"))
    per = j.groupBy(stream).agg(
        F.count_if("first").alias("received_unique"), F.countDistinct(F.when(F.col("correct"), F.col("sequence"))).alias("correct_unique"),
        F.count_if(F.col("known") & ~F.col("first")).alias("duplicates"), F.count_if(~F.col("known")).alias("unrelated_replies"), F.count_if(F.col("known") & ~F.col("correct")).alias("mismatches"),
    )
    asked = expected.groupBy(stream).agg(F.count("*").alias("requested"))
    zero = ("received_unique", "correct_unique", "duplicates", "out_of_order", "unrelated_replies", "mismatches")
    d = asked.join(per, stream, "left").join(order, stream, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return d.select(stream, "requested", "received_unique", "correct_unique", (F.col("requested") - F.col("received_unique")).alias("missing"), *zero[2:])


def missing_sequences(expected: DataFrame, replies: DataFrame, stream: str = "stream_id") -> DataFrame:
    return expected.select(stream, "sequence").join(replies, [stream, "sequence"], "left_anti")


def batch_reply_summary(expected: DataFrame, replies: DataFrame, threshold: int) -> DataFrame:
    """Per batch: count_error (reply's and batch's sizes differ), wrong_scores, complete (all rows correct).

    expected: batch, scores array. replies: batch, scores array, arrival; the first reply counts.
    """
    first = replies.groupBy("batch").agg(F.min_by("scores", "arrival").alias("got"), F.count("*").alias("replies"))
    d = expected.join(first, "batch", "left")
    wrong = F.size(F.filter(F.zip_with("scores", "got", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    bad = F.size("scores") != F.size("got")
    return d.select(
        "batch", F.size("scores").alias("rows"), F.coalesce("replies", F.lit(0)).alias("replies"), F.coalesce(bad, F.lit(False)).alias("count_error"),
        F.when(F.col("got").isNotNull() & ~bad, wrong).otherwise(F.size("scores")).alias("wrong_scores"), F.coalesce(F.col("got").isNotNull() & ~bad & (wrong == 0), F.lit(False)).alias("complete"),
    )


def completion_rate(expected: DataFrame, replies: DataFrame, threshold: int, started: str = "started", stream: str = "stream_id") -> DataFrame:
    """Per stream: seconds from its start to the last first-correct arrival, and rows per second; null unless complete."""
    right = judged_replies(expected, replies, threshold, stream).filter("correct").groupBy(stream, "sequence").agg(F.min("arrival").alias("at"))
    per = right.groupBy(stream).agg(F.count("*").alias("correct"), F.max("at").alias("last"))
    asked = expected.groupBy(stream).agg(F.count("*").alias("requested"), F.min(started).alias("start"))
    whole = F.col("correct") == F.col("requested")
    seconds = F.when(whole, F.col("last") - F.col("start"))
    return asked.join(per, stream, "left").select(stream, "requested", F.coalesce("correct", F.lit(0)).alias("correct"), F.round(seconds, 6).alias("seconds"), F.round(F.try_divide(F.col("requested"), seconds), 6).alias("rows_per_second"))


def timing_statistics(df: DataFrame, sent: str = "sent", arrived: str = "arrived", stream: str = "stream_id", order: str = "sequence") -> DataFrame:
    """Per stream: samples, total, median, p95 and max of latency, the same of spacing between arrivals, negative samples."""
    d = before_in_stream(df.withColumn("latency", F.col(arrived) - F.col(sent)), stream, [arrived, order], arrived, "before__").withColumn("spacing", F.col(arrived) - F.col("before__"))
    per = d.groupBy(stream).agg(
        F.count("latency").alias("samples"), F.round(F.sum("latency"), 6).alias("latency_total"), F.round(F.max("latency"), 6).alias("latency_max"), F.count("spacing").alias("spacings"),
        F.round(F.sum("spacing"), 6).alias("spacing_total"), F.round(F.max("spacing"), 6).alias("spacing_max"), F.count_if(F.col("latency") < 0).alias("negative_latencies"),
    )
    for c in ("latency", "spacing"):
        per = per.join(stream_quantiles(d, stream, c, {f"{c}_median": 0.5, f"{c}_p95": 0.95}), stream, "left")
    ordered = ("samples", *(f"latency_{x}" for x in ("total", "median", "p95", "max")), "spacings", *(f"spacing_{x}" for x in ("total", "median", "p95", "max")), "negative_latencies")
    return per.select(stream, *[F.round(c, 6).alias(c) if c.endswith(("median", "p95")) else F.col(c) for c in ordered])


def cross_path_check(a: DataFrame, b: DataFrame, expected: DataFrame, key: str = "request") -> DataFrame:
    """One row: requests, where path a, path b or both disagree with what was expected, and breaks in either path's own
    sequence (each must be one more than the last, modulo 2^32).

    a, b: request, score, path_sequence. expected: request, score. Windows run per range of requests.
    """
    e = expected.select(key, F.col("score").alias("want"))
    d = e.join(a.select(key, F.col("score").alias("sa"), F.col("path_sequence").alias("qa")), key, "left").join(b.select(key, F.col("score").alias("sb"), F.col("path_sequence").alias("qb")), key, "left")
    # the row before is request - 1: a join on it needs no window over all rows
    p = d.select((F.col(key) + 1).alias(key), F.col("qa").alias("pa"), F.col("qb").alias("pb"))
    j = d.join(p, key, "left")
    broken = lambda now, last: F.count_if(F.col(last).isNotNull() & ~F.col(now).eqNullSafe((F.col(last) + 1).bitwiseAND(F.lit(4294967295))))
    return j.agg(F.count("*").alias("requests"), F.count_if(~F.col("sa").eqNullSafe(F.col("want"))).alias("wrong_a"), F.count_if(~F.col("sb").eqNullSafe(F.col("want"))).alias("wrong_b"), F.count_if(~F.col("sa").eqNullSafe(F.col("sb"))).alias("paths_differ"), broken("qa", "pa").alias("breaks_a"), broken("qb", "pb").alias("breaks_b"))
