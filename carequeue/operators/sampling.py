"""Repeatable samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A quadratic over the residues of a prime: its products stay within 64 bits.
PRIME = 2147483647
MULTIPLIER = 48271
#: Groups in which tasks' smallest rows are merged before they meet.
MERGES = 64


def sample_key(row_id: str, seed: int) -> Column:
    """Scrambled row id in [0, PRIME), the same in every run."""
    mixed = f"pmod((pmod({row_id}, {PRIME}) + {seed % PRIME}) * {MULTIPLIER}, {PRIME})"
    return F.expr(f"pmod({mixed} * {mixed} + {mixed}, {PRIME})")


def fixed_sample(df: DataFrame, size: int, seed: int = 42, row_id: str = "patient_id") -> DataFrame:
    """The ``size`` rows with the smallest keys, or all rows if there are fewer.

    Rows are read once. Each task keeps the smallest of its own rows, which are merged in
    ``MERGES`` groups and these in the end: what is passed on never exceeds ``size`` rows
    per task and group.
    """
    if size <= 0:
        return df.limit(0)
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        sample_key(row_id, seed).alias("_key"),
        F.col(row_id).alias("_id"),
        (F.spark_partition_id() % MERGES).alias("_group"),
    )
    nth = Window.partitionBy("_group").orderBy("_key", "_id")
    smallest = keyed.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= size)
    return smallest.orderBy("_key", "_id").limit(size).select("_row.*")


def preview(df: DataFrame, size: int = 10, row_id: str = "patient_id") -> DataFrame:
    """First rows by id."""
    return df.orderBy(row_id).limit(size)
