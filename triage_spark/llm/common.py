"""What the corpus operators share: checkpoints, deterministic samples, global prefix sums."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage_spark.sources import scratch
from triage_spark.sources.scratch import forget, shared_folder  # noqa: F401


BATCH = 1024  # texts in an Arrow batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage; partitions and the order of their rows stay. The sizes that Spark estimates stay too: see stored()."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """scratch.stored(), for a plan with Python in it also with at most batch_rows rows in an Arrow batch."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if batch_rows is None:
        return scratch.stored(df)
    was = conf.get(name)
    conf.set(name, str(min(batch_rows, int(was)) if int(was) > 0 else batch_rows))
    try:
        return scratch.stored(df)
    finally:
        conf.set(name, was)


def trim() -> None:
    """Hand what a task no longer needs back to the system: Python workers stay alive between tasks, and memory is counted with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those with the least xxhash64(key): the same rows on every run.

    Two passes: the n least hashes (8 bytes each) give a limit, then the rows under it.
    """
    h = F.xxhash64(F.col(key))
    least = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.filter(h <= F.lit(least)).limit(n) if least is not None else df.limit(0)


def prefix_sums(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Rows in the global order of `order`, with exclusive running totals.

    Adds `<name>_before` for each of `sums` (nulls count as 0) and `rows_before`. The rows are range
    partitioned and sorted once, then written to a checkpoint so that partition numbers stay. One row of
    totals per partition reaches the driver; each partition then adds up its own rows in Arrow batches.
    No window without partitions, no task with more than its own range. An empty table stays empty.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    cols = df.columns
    ranged = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("pid__", F.spark_partition_id())
    totals = ranged.groupBy("pid__").agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in sums]).collect()
    before, at = {}, [0] * (len(sums) + 1)
    for r in sorted(totals, key=lambda r: r["pid__"]):
        before[r["pid__"]] = list(at)
        at = [a + r[c] for a, c in zip(at, ["rows", *sums])]
    names = ["rows_before", *(f"{c}_before" for c in sums)]
    schema = T.StructType([*ranged.drop("pid__").schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def add(batches):
        own = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            own = own or list(before[t["pid__"][0].as_py()])
            out = [t[c].combine_chunks() for c in cols]
            ones = pa.array([1] * b.num_rows, pa.int64())
            for k, v in enumerate([ones, *(pc.fill_null(t[c].combine_chunks().cast(pa.int64()), 0) for c in sums)]):
                inclusive = pc.cumulative_sum(v)
                out.append(pc.add(pc.subtract(inclusive, v), own[k]))
                own[k] += inclusive[-1].as_py()
            yield pa.RecordBatch.from_arrays(out, names=[*cols, *names])

    return ranged.mapInArrow(add, schema)
