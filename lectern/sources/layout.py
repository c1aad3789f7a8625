"""How rows are dealt over tasks, which changes no result, and where shared files go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table for each core, up to which redealing costs next to nothing.
SMALL_SPLIT = 4 << 20
#: Bytes of an Arrow batch, about. Spark's own bound is 10,000 rows, which of texts are a whole split, once in the JVM and once in Python.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def input_bytes(table: DataFrame) -> int:
    """The optimizer's size estimate: file sizes for tables. It only sets how finely work is dealt out."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(table: DataFrame) -> DataFrame:
    """The table over all cores, if it is so small that its files and row groups leave most of them idle.

    A scan makes no more tasks with rows than there are row groups, so heavy expressions over a small file run on
    one core. A table of SMALL_SPLIT a core or more is left as it lies.
    """
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if input_bytes(table) >= SMALL_SPLIT * cores or len(table.inputFiles()) >= cores:
        return table
    return table.repartition(cores)


def bound_batches(spark: SparkSession) -> bool:
    """Arrow batches of about BATCH_BYTES in this session from now on, unless it has a bound in bytes; whether it had none."""
    if spark.conf.get(_BATCH_BYTES, None) is not None:
        return False
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return True


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES for what runs inside the block."""
    new = bound_batches(spark)
    try:
        yield
    finally:
        if new:
            spark.conf.unset(_BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder for a local master, and an error for others."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        where = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, where, True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path for this application under the shared folder."""
    return f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """frame written under the shared folder and read back: lineage is cut, and a lost executor costs a re-read only."""
    path = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
