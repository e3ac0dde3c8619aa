"""Where intermediate tables go: the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once. Texts can be long; the kernels slice further by bytes.
BATCH_ROWS = 1000
#: And their bytes: the JVM and the worker each hold a batch or more outside of the heap.
BATCH_BYTES = 4 << 20
#: Spark drops the shuffle files of a query when it ends; intermediate tables are written once and then read.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a session in one process (tests) makes a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bytelode-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str, **options: str) -> None:
    """Writes Parquet and lets go of the shuffle files that it took."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was else spark.conf.unset(CLEANUP)


def written(df: DataFrame, name: str, compact: bool = False, **options: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: its lineage ends there.

    compact: a table much smaller than what it is made from is dealt anew, so that it has few files.
    """
    df = df.hint("rebalance") if compact else df
    path = scratch(df.sparkSession, name)
    write_once(df, path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` made, when all that reads them has been written itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The ``bound`` rows of the smallest hash of ``key``, or all if there are fewer.

    A count tells which share of all hashes is sure to hold them with room to spare, so that each task passes on its
    part of that share only, not ``bound`` rows.
    """
    n = df.count()
    if n > 4 * bound:
        top = 4 * bound + 1000
        df = df.where(F.xxhash64(key) < F.lit(min((1 << 63) - 1, -(1 << 63) + top * (1 << 64) // n)))
    return df.orderBy(F.xxhash64(key), key).limit(bound)
