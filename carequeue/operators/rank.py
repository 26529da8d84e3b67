"""Whole-table ranks and running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carequeue.operators.shared import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def rank_rows(df: DataFrame, *order: Column, position: str = "queue_position") -> DataFrame:
    """Add positions 1..n in the given order; include a unique key to make it total.

    The rows are range-sorted, so a heavy key is split as long as the order ends in a
    unique column, and written once with the partition and row number of each. The rows
    before each partition are then a running sum over one count per partition. The
    written table fixes partition and row numbers, whatever is recomputed later.
    """
    numbered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = written(numbered, "rank").withColumns(
        {
            "_partition": F.shiftright("_at", _ROW_BITS),
            "_row": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_partition")
        .agg(F.count("*").alias("_rows"))
        .select("_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # one row per sort partition: at most spark.sql.shuffle.partitions rows
    return stored.join(F.broadcast(starts), "_partition").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_start") + F.col("_row") + 1).alias(position),
    )


def running_sums(df: DataFrame, *order: Column, sums: dict[str, str], by: str) -> DataFrame:
    """Add to each row sums over itself and the rows of its ``by`` value that come before.

    ``sums`` names the added columns and the columns that they add up. ``order`` must be
    total within ``by``, which has no nulls. Rows are range-sorted by both, so a heavy value is split over
    partitions; each adds up its own rows and starts from the sums of those before, of
    which there is one row per partition and value.
    """
    sorted_rows = df.orderBy(by, *order).withColumn("_partition", F.spark_partition_id())
    stored = written(sorted_rows, "running")
    within = Window.partitionBy("_partition", by).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (
        Window.partitionBy(by)
        .orderBy("_partition")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        stored.groupBy(by, "_partition")
        .agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
        .select(by, "_partition", *[F.sum(f"_sum_{n}").over(before).alias(f"_start_{n}") for n in sums])
    )
    added = {n: F.sum(c).over(so_far) for n, c in sums.items()}
    totals = stored.select("*", *[c.alias(f"_so_far_{n}") for n, c in added.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in sums]
    return totals.join(starts, [by, "_partition"]).select(
        *kept,
        *[
            (F.col(f"_so_far_{n}") + F.coalesce(f"_start_{n}", F.lit(0))).alias(n)
            for n in sums
        ],
    )
