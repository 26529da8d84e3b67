"""Intermediate tables written to the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """``folder`` if given, else ``spark.checkpoint.dir``, else a folder in the warehouse.

    All three are storage that the driver and every executor read and write; nothing is
    kept on one machine.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path nothing was written to yet; deleted with the scope it is made in."""
    path = f"{shared_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The same rows, computed once and read back from a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Estimated bytes up to which rows that cost much each are dealt out to all cores.
SMALL_BYTES = 64 << 20


def dealt_out_if_small(df: DataFrame) -> DataFrame:
    """The same rows, spread over all cores if they lie in few files.

    A small table is read by a task or two, however much work each of its rows makes. A
    large one has splits enough, and its rows stay where they are.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def at_the_same_time(*builds: Callable[[], Any]) -> list[Any]:
    """Results of functions that write intermediate tables, their jobs side by side."""
    with ThreadPoolExecutor(max(1, len(builds))) as pool:
        begun = [pool.submit(copy_context().run, build) for build in builds]
        return [b.result() for b in begun]


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table, through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the intermediate tables that it wrote.

    Results are evaluated late, so write or collect them inside the block.
    """
    token = _SCOPE.set([])
    try:
        yield
    finally:
        made = _SCOPE.get()
        _SCOPE.reset(token)
        for path in made:
            delete_table(spark, path)
