"""Whole rows of a table in Arrow batches, worked on inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to workers ``ROWS_AT_ONCE`` at a time in jobs that run inside the block.

    A batch lies in memory twice, in the executor and in its worker; Spark's 10,000 whole
    texts are too many. Results do not depend on it. A smaller setting is kept.
    """
    before = spark.conf.get(_BATCH_ROWS)
    if 0 < int(before) <= ROWS_AT_ONCE:
        yield
        return
    spark.conf.set(_BATCH_ROWS, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def parts_of(
    batch: pa.RecordBatch, text: str, bytes_at_once: int = BYTES_AT_ONCE
) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some rows and about some bytes of text at most; a text that
    is longer is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, before + bytes_at_once, "right"))
        stop = max(at + 1, min(stop, at + ROWS_AT_ONCE))
        yield batch.slice(at, stop - at)
        at = stop


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list], list]],
    columns: str,
    text: str = "text",
    keep_text: bool = False,
    bytes_at_once: int = BYTES_AT_ONCE,
) -> DataFrame:
    """Add columns made from the text of each row and drop the text, unless it is kept.

    ``make()`` runs once per task and gives a function from a list of texts (nulls as
    empty) to a list of tuples, one value per added column. ``columns`` is the schema of
    the added columns. Other columns pass unchanged. The function is given about
    ``bytes_at_once`` of text at most, fewer where it holds many times as much. What a task
    has freed goes back to the system, as idle workers count with the executor that they
    belong to.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if keep_text or c != text]
    spark = df.sparkSession
    added = spark.createDataFrame([], columns).schema
    schema = df.select(*[f"`{c}`" for c in kept]).schema
    for field in added.fields:
        schema = schema.add(field)
    types = to_arrow_schema(added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()

        def worked(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(text).to_pylist()]
            made = list(zip(*fn(texts), strict=True))
            arrays = [part.column(c) for c in kept]
            arrays += [pa.array(v, f.type) for v, f in zip(made, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*kept, *types.names])

        for batch in batches:
            yield from map(worked, parts_of(batch, text, bytes_at_once))
            del batch  # not held while the next one is read
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(work, schema)
