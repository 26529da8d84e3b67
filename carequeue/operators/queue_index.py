"""A stored queue that arriving batches join without sorting all of it again.

The rows of a queue lie in buckets, each a range of the order, with their places inside
the bucket. A manifest lists the buckets in order with their least keys, sizes and files.
A row's position is the number of rows in the buckets before its own plus its place.

A new batch is sorted by itself, together with the buckets' least keys, which tells the
bucket of each row. Only buckets that get rows are read, merged and written again, and cut
where they have grown too large; all others keep their files, and their rows move up
because the sizes before them grow. A batch becomes part of the queue when its manifest
is written; if a job fails before, the queue is as it was, and the batch can be added again.
Each state has one successor: adding another batch to an earlier state replaces the later.

Rows are ordered by columns given as SQL expressions, ascending, the last of them unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carequeue.operators.rank import running_sums
from carequeue.operators.shared import new_path

ROWS_IN_BUCKET = 1_000_000
#: Buckets up to this number are sent to all tasks; more are joined by shuffling.
BROADCAST_BUCKETS = 200_000

#: The order of a waiting list: by priority, then days waited, then id.
BY_PRIORITY = (
    "if(priority_score is null, double('infinity'), -priority_score)",
    "if(wait_days is null, 2147483648, -cast(wait_days as long))",
    "patient_id",
)

_OWN = ("_bucket", "_place")


def _key(order: Sequence[str]) -> Column:
    return F.expr(f"named_struct({', '.join(f"'k{i}', {e}" for i, e in enumerate(order))})")


@dataclass(frozen=True)
class StoredQueue:
    """The folder of a queue and the number of batches that are in it."""

    folder: str
    batches: int
    order: tuple[str, ...] = BY_PRIORITY
    rows_in_bucket: int = ROWS_IN_BUCKET

    def _rows_path(self, batch: int) -> str:
        return f"{self.folder}/rows-{batch}"

    def _manifest_path(self, batch: int) -> str:
        return f"{self.folder}/manifest-{batch}"

    def manifest(self, spark: SparkSession) -> DataFrame:
        """(bucket, batch, rows, least) of every bucket, ``least`` its first key."""
        return spark.read.parquet(self._manifest_path(self.batches))

    def _live_rows(self, spark: SparkSession, buckets: DataFrame) -> DataFrame:
        """Rows of the given (bucket, batch), each read from the batch that wrote it last."""
        parts = [
            spark.read.parquet(self._rows_path(r.batch)).join(
                _sent(buckets.where(F.col("batch") == r.batch).select(F.col("bucket").alias("_bucket"))),
                "_bucket",
                "left_semi",
            )
            # as many as batches of which a bucket is left
            for r in buckets.select("batch").distinct().orderBy("batch").collect()
        ]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        return every


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_BUCKETS else df


def _stored(
    queue: StoredQueue, rows: DataFrame, kept: DataFrame | None, batch: int
) -> StoredQueue:
    """Write rows with a bucket ordinal ``_in`` as new buckets, then the manifest."""
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "_in"]
    keyed = rows.withColumn("_k", _key(queue.order)).withColumn("_place", F.lit(1).cast("long"))
    keys = [F.col(f"_k.k{i}") for i in range(len(queue.order))]
    placed = running_sums(keyed, *keys, sums={"_place": "_place"}, by="_in")
    cut = F.expr(f"(_place - 1) div {queue.rows_in_bucket}")
    bucket = F.concat_ws("-", F.lit(str(batch)), "_in", cut)
    placed = placed.withColumns(
        {
            "_bucket": bucket,
            "_place": F.expr(f"(_place - 1) % {queue.rows_in_bucket} + 1").cast("long"),
        }
    )
    path = queue._rows_path(batch)
    placed.select("_bucket", "_place", *[f"`{c}`" for c in columns]).write.mode(
        "overwrite"
    ).parquet(path)
    made = (
        spark.read.parquet(path)
        .groupBy(F.col("_bucket").alias("bucket"))
        .agg(F.count("*").alias("rows"), F.min(_key(queue.order)).alias("least"))
        .select("bucket", F.lit(batch).alias("batch"), "rows", "least")
    )
    manifest = made if kept is None else kept.unionByName(made)
    manifest.write.mode("overwrite").parquet(queue._manifest_path(batch))
    return StoredQueue(queue.folder, batch, queue.order, queue.rows_in_bucket)


def new_queue(
    rows: DataFrame,
    order: Sequence[str] = BY_PRIORITY,
    folder: str | None = None,
    rows_in_bucket: int = ROWS_IN_BUCKET,
) -> StoredQueue:
    """A queue of a first batch, which is sorted as a whole."""
    folder = folder or new_path(rows.sparkSession, "queue")
    queue = StoredQueue(folder, 0, tuple(order), rows_in_bucket)
    return _stored(queue, rows.withColumn("_in", F.lit(0).cast("long")), None, 1)


def open_queue(
    spark: SparkSession,
    folder: str,
    order: Sequence[str] = BY_PRIORITY,
    rows_in_bucket: int = ROWS_IN_BUCKET,
) -> StoredQueue:
    """The queue in a folder with all batches whose manifest was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    queue = StoredQueue(folder, 0, tuple(order), rows_in_bucket)
    batches = 0
    while fs.exists(at(f"{queue._manifest_path(batches + 1)}/_SUCCESS")):
        batches += 1
    if not batches:
        raise ValueError(f"there is no queue in {folder}")
    return StoredQueue(folder, batches, tuple(order), rows_in_bucket)


def add_batch(queue: StoredQueue, batch: DataFrame) -> StoredQueue:
    """The queue with the rows of a batch; ids must be new to it."""
    spark = batch.sparkSession
    manifest = queue.manifest(spark)
    if manifest.isEmpty():
        rows = batch.withColumn("_in", F.lit(0).cast("long"))
        return _stored(queue, rows, None, queue.batches + 1)
    # the batch among the least keys: the keys counted up to a row tell its bucket
    columns = batch.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    of_batch = batch.select(_key(queue.order).alias("_k"), row.alias("_row"), F.lit(0).cast("long").alias("_in"))
    marks = manifest.select(
        F.col("least").alias("_k"),
        F.lit(None).cast(of_batch.schema["_row"].dataType).alias("_row"),
        F.lit(1).cast("long").alias("_in"),
    )
    keys = [F.col(f"_k.k{i}") for i in range(len(queue.order))]
    counted = running_sums(
        of_batch.union(marks).withColumn("_all", F.lit(True)),
        *keys,
        F.desc("_in"),
        sums={"_in": "_in"},
        by="_all",
    )
    # what comes before every bucket joins the first
    routed = counted.where("_row is not null").select(
        "_row.*", F.greatest("_in", F.lit(1).cast("long")).alias("_in")
    )
    # one row per bucket meets in one task
    numbered = manifest.withColumn(
        "_in", F.row_number().over(Window.orderBy("least")).cast("long")
    )
    touched = routed.select("_in").distinct()
    grown = numbered.join(touched, "_in", "left_semi")
    kept = numbered.join(touched, "_in", "left_anti").drop("_in")
    if grown.isEmpty():
        merged = routed
    else:
        old = queue._live_rows(spark, grown).drop("_place")
        old = old.join(
            _sent(grown.select(F.col("bucket").alias("_bucket"), "_in")), "_bucket"
        ).select(*[F.col(f"`{c}`") for c in columns], "_in")
        merged = old.unionByName(routed)
    return _stored(queue, merged, kept, queue.batches + 1)


def positions(queue: StoredQueue, spark: SparkSession) -> DataFrame:
    """All rows with ``queue_position`` 1..n; nothing is sorted but the manifest."""
    manifest = queue.manifest(spark)
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select(
        F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"),
    )
    if manifest.isEmpty():
        rows = spark.read.parquet(queue._rows_path(queue.batches))
    else:
        rows = queue._live_rows(spark, manifest)
    return rows.join(_sent(starts), "_bucket").select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in _OWN],
        (F.col("_start") + F.col("_place")).alias("queue_position"),
    )
