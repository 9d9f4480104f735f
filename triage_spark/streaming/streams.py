"""Live scoring, request/reply matching and reply state."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from triage_spark.functions import variants as V
from triage_spark.operators import scoring


def stream_score(sdf: DataFrame, model: scoring.Model, threshold: int) -> DataFrame:
    """Unbounded feature rows scored and routed; stateless, so any sink and output mode append."""
    return scoring.score(sdf, model).withColumn("route", V.apply_route(F.col("score"), threshold))


def stream_match_replies(requests: DataFrame, replies: DataFrame, timeout: str = "5 seconds", delay: str = "10 seconds", threshold: int = 0) -> DataFrame:
    """Each request with its reply inside the timeout; a request without one comes out as missing once the
    watermark has passed. requests: stream_id, sequence, sent, expected_score. replies: stream_id, sequence,
    arrived, score, classification, deep_review. The watermarks bound the state on both sides."""
    a = requests.withWatermark("sent", delay).alias("a")
    b = replies.withWatermark("arrived", delay).alias("b")
    on = (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("a.sequence") == F.col("b.sequence")) & (F.col("b.arrived") >= F.col("a.sent")) & (F.col("b.arrived") <= F.col("a.sent") + F.expr(f"INTERVAL {timeout}"))
    d = a.join(b, on, "left_outer")
    flags = (F.col("b.classification") != (F.col("b.score") >= 0).cast("int")) | (F.col("b.deep_review") != (F.col("b.score") >= threshold).cast("int"))
    status = F.when(F.col("b.sequence").isNull(), "missing").when(flags, "flag_mismatch").when(F.col("b.score") != F.col("a.expected_score"), "score_mismatch").otherwise("matched")
    return d.select("a.stream_id", "a.sequence", "a.sent", "b.arrived", status.alias("status"))


def stream_distinct_replies(replies: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """First replies only: repeats inside the watermark are dropped."""
    return replies.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["stream_id", "sequence"])


BLOCK = 4096  # sequences of one bitmap
PAGE = 256  # blocks that are read and written together
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class ReplyState(StatefulProcessor):
    """Counters of one stream, and bitmaps of the sequences seen, block by block, each with the time it was last touched.

    A call to the state store costs far more than its bytes, so PAGE blocks lie in one entry, compressed: a batch reads and
    writes each page of a stream once, however its replies lie in the blocks. The counters know whether a timer is set.
    """

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "previous bigint, received_unique bigint, duplicates bigint, out_of_order bigint, timer bigint")
        self.pages = handle.getMapState("pages", "page bigint", "blocks binary, last binary, bits binary")

    def read(self, value: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of a page in order, when each was last touched, and a row of bits for each."""
        if value is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BLOCK // 8), np.uint8)
        blocks, last, bits = map(bytes, value)
        return np.frombuffer(blocks, np.int64), np.frombuffer(last, np.int64), np.frombuffer(zlib.decompress(bits), np.uint8).reshape(-1, BLOCK // 8)

    def write(self, page: int, blocks: np.ndarray, last: np.ndarray, bits: np.ndarray) -> None:
        self.pages.updateValue((page,), (blocks.tobytes(), last.tobytes(), zlib.compress(bits.tobytes(), 1)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p.sequence.to_numpy(np.int64), p.arrived.to_numpy("datetime64[ms]").astype(np.int64), p.arrived.to_numpy("datetime64[ns]")) for p in rows]
        sequence, arrived, exact = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((sequence, exact))
        sequence, arrived = sequence[order], arrived[order]
        fresh = np.zeros(len(sequence), dtype=bool)
        fresh[np.unique(sequence, return_index=True)[1]] = True
        block, bit = np.divmod(sequence, BLOCK)
        page = block // PAGE
        for p in np.unique(page).tolist():
            own = np.flatnonzero(page == p)
            known, was, old = self.read(self.pages.getValue((p,)))
            blocks, at = np.unique(np.concatenate([known, block[own]]), return_inverse=True)
            bits, last = np.zeros((len(blocks), BLOCK // 8), np.uint8), np.zeros(len(blocks), np.int64)
            bits[at[: len(known)]], last[at[: len(known)]] = old, was
            row, byte, mask = at[len(known) :], bit[own] // 8, (128 >> bit[own] % 8).astype(np.uint8)
            fresh[own] &= bits[row, byte] & mask == 0
            np.bitwise_or.at(bits, (row, byte), mask)
            np.maximum.at(last, row, arrived[own])
            self.write(p, blocks, last, bits)
        previous, unique, repeated, back, timer = self.counts.get() or (None, 0, 0, 0, None)
        first = sequence[fresh]
        if len(first):
            before = first[:-1] if previous is None else np.concatenate([[previous], first[:-1]])
            back += int((first[len(first) - len(before) :] < before).sum())
            previous = int(first[-1])
        unique, repeated = unique + len(first), repeated + len(sequence) - len(first)
        if timer is None:
            timer = int(arrived.max()) + self.horizon
            self.handle.registerTimer(timer)
        self.counts.update((previous, unique, repeated, back, timer))
        yield pd.DataFrame({"stream_id": [key[0]], "received_unique": [unique], "duplicates": [repeated], "out_of_order": [back]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Blocks untouched for the horizon go; a stream without any block goes as a whole."""
        cut, left = timerValues.getCurrentWatermarkInMs() - self.horizon, None
        for (p,), value in list(self.pages.iterator()):
            blocks, last, bits = self.read(value)
            stay = last > cut
            if not stay.any():
                self.pages.removeKey((p,))
                continue
            if not stay.all():
                self.write(p, blocks[stay], last[stay], bits[stay])
            oldest = int(last[stay].min())
            left = oldest if left is None else min(left, oldest)
        if left is None:
            self.counts.clear()
        else:
            self.handle.registerTimer(left + self.horizon)
            self.counts.update((*self.counts.get()[:4], left + self.horizon))
        return iter([])

    def close(self) -> None:
        pass


def stream_reply_state(replies: DataFrame, horizon: str = "1 hour", delay: str = "10 seconds") -> DataFrame:
    """Running counters per stream: received_unique, duplicates, out_of_order; out in update mode.

    A reply counts as a duplicate while its block of BLOCK sequences has been touched within `horizon` of event time.
    Timers of event time drop older blocks, and a stream that has been silent for the horizon with its counters, so the
    state follows what arrives in a horizon and not the age or the gaps of a stream. Checkpoints of the form before pages are not read. Within a batch rows are taken by arrival,
    then sequence. Needs the RocksDB state store (use_rocksdb()). stream_id, sequence: whole numbers; arrived: instants.
    """
    ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
    schema = "stream_id bigint, received_unique bigint, duplicates bigint, out_of_order bigint"
    rows = replies.withWatermark("arrived", delay)
    return rows.groupBy("stream_id").transformWithStateInPandas(ReplyState(ms), schema, "Update", "EventTime")


@contextlib.contextmanager
def use_rocksdb(spark: SparkSession):
    """The state store that timers and several state variables need, while streams are started."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)


def read_events(spark: SparkSession, sf_dir: str, schema) -> DataFrame:
    """The events table as a stream of files; its times are cast to instants, as watermarks ask for."""
    path = f"{sf_dir}/events.parquet"
    whole = spark.read.parquet(path).inputFiles()
    as_file = len(whole) == 1 and whole[0].endswith("/events.parquet")
    reader = spark.readStream.schema(schema)
    rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if as_file else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
