"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or else the one that the context was given.

    Where neither is set, a session of one process (tests, one machine) takes a temporary folder; on a cluster that is
    an error, as executors do not share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, prefix: str = "table") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; rows come back in any order.

    Unlike a checkpoint, which hands the estimated size of its plan on, so that a chain of joins multiplies it until the
    number alone fills the driver, a table has the size of its files. The shuffles that made it go with its writing.
    """
    spark = df.sparkSession
    at = new_folder(spark)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in at:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
