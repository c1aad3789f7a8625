"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.layout import bounded_batches, input_bytes, shared_dir

#: The innermost open scope's tables, oldest first; None outside any scope.
_scope: ContextVar[list[str] | None] = ContextVar("lectern_scratch", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of what this context writes inside the block, for `release`. Scopes nest, and other threads have their own."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back, so that a lost executor costs a re-read only.
    Its Arrow batches are bounded in bytes."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete these tables; results that still read them have to be stored before."""
    for path in paths:
        _delete(spark, path)


@contextmanager
def last_kept(spark: SparkSession) -> Iterator[None]:
    """Of the tables written inside the block only the last one stays, and belongs to the scope around: for steps that store their result."""
    with scope() as used:
        yield
    release(spark, used[:-1])
    if (outer := _scope.get()) is not None:
        outer += used[-1:]


def release_all(spark: SparkSession) -> None:
    """Delete whatever this application wrote here, for its end."""
    _delete(spark, app_dir(spark))


def parts(df: DataFrame, per: int, least: int = 16) -> int:
    """How many buckets of about `per` input bytes each, however many that are."""
    return max(least, input_bytes(df) // per)
