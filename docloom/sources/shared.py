"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own where that is unset, and only if driver and tasks share the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "docloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows and bytes of an Arrow batch at most: long texts would make the default of 10,000 rows too large for a worker.
BATCH_ROWS, BATCH_BYTES = 4_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back_memory() -> None:
    """Freed memory goes back to the system: a Python worker serves many tasks and would keep the largest one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than cores, as rows over all cores: Spark does not cut a small file with one row group, so one task would do all the work. Larger tables have splits enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if len(df.inputFiles()) < cores and size < cores * (128 << 20) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again: plans stay short, lost executors cost nothing that is done."""
    path = f"{shared_folder(df.sparkSession)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
