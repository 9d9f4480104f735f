"""Contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import prefix_sums

ROW_BYTES = 8


def shard(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of n_shards contiguous runs of the `key` order, equal in bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Global prefix sums come from per-partition
    totals; a row goes to the shard in which the middle of its byte range falls, so a cut is off by half a
    row at most, and a row larger than a shard leaves neighbours empty. Null keys come first, rows of one
    key are ordered by checksum and size, and repeated rows lie side by side. An empty table gives no rows.
    Only (key, size, checksum) are shuffled, never the text. Other columns are not carried.

    Returns key, size, text_crc32, shard, slot (place in the shard, from 0), bytes_before.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(t) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    summed = prefix_sums(rows, [key, "text_crc32", "size"], ["size"])
    total = summed.agg(F.max(F.col("size_before") + F.col("size"))).first()[0] or 1
    middle = (F.lit(2) * F.col("size_before") + F.col("size")) * F.lit(n_shards)
    cut = summed.withColumn("shard", F.least(F.expr("0L") + F.floor(middle / F.lit(2 * total)), F.lit(n_shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("rows_before").alias("first_row"))
    return cut.join(F.broadcast(firsts), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first_row")).alias("slot"), F.col("size_before").alias("bytes_before")
    )
