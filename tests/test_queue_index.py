"""A stored queue after each batch against one rank over all rows so far."""

import pytest
from pyspark.sql import functions as F

from carequeue.operators import capacity as C
from carequeue.operators import queue_index as W


def people(spark, lo, hi):
    """A third share one key, some have none."""
    key = F.expr("if(id % 3 = 0, 0.5D, if(id % 50 = 1, null, (id * 7919 % 101) / 100D))")
    return spark.range(lo, hi).select(
        F.col("id").alias("patient_id"),
        key.alias("priority_score"),
        F.expr("cast(if(id % 3 = 0, 50, if(id % 77 = 5, null, id * 31 % 29)) as int)").alias("wait_days"),
    )


def same(spark, queue, rows):
    found = {(r.patient_id, r.queue_position) for r in W.positions(queue, spark).collect()}
    assert found == {(r.patient_id, r.queue_position) for r in C.queue_positions(rows).collect()}
    assert len(found) == rows.count()


def test_positions_after_each_of_three_batches(spark):
    rows_in_bucket = 300
    batches = [people(spark, 0, 1500), people(spark, 1500, 1600), people(spark, 1600, 4000)]
    queue, so_far = None, None
    for batch in batches:
        if queue is None:
            queue, so_far = W.new_queue(batch, rows_in_bucket=rows_in_bucket), batch
        else:
            queue, so_far = W.add_batch(queue, batch), so_far.union(batch)
        same(spark, queue, so_far)
    sizes = [r.rows for r in queue.manifest(spark).collect()]
    assert max(sizes) <= rows_in_bucket and sum(sizes) == 4000


def test_a_batch_writes_only_the_buckets_it_meets(spark):
    queue = W.new_queue(people(spark, 0, 3000), rows_in_bucket=100)
    # all of one key, at one place of the order
    late = spark.range(9000, 9040).selectExpr(
        "id as patient_id", "0.11D as priority_score", "3 as wait_days"
    )
    after = W.add_batch(queue, late)
    same(spark, after, people(spark, 0, 3000).union(late))
    counts = {r.batch: r["count"] for r in after.manifest(spark).groupBy("batch").count().collect()}
    assert counts[1] == queue.manifest(spark).count() - 1 and counts[2] <= 3
    written = spark.read.parquet(f"{after.folder}/rows-2").count()
    assert written <= 140
    same(spark, queue, people(spark, 0, 3000))  # the state before is still there


def test_empty_batches_and_queues(spark):
    none = people(spark, 0, 0)
    queue = W.new_queue(none)
    assert W.positions(queue, spark).count() == 0
    queue = W.add_batch(queue, people(spark, 0, 50))
    queue = W.add_batch(queue, none)
    same(spark, queue, people(spark, 0, 50))


def test_positions_sort_nothing_but_the_manifest(spark):
    queue = W.add_batch(W.new_queue(people(spark, 0, 500)), people(spark, 500, 900))
    plan = W.positions(queue, spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("SinglePartition") == 1
    assert "rangepartitioning" not in plan


def test_a_failed_batch_can_be_added_again(spark):
    queue = W.new_queue(people(spark, 0, 400), rows_in_bucket=100)
    broken = people(spark, 400, 500).withColumn(
        "wait_days", F.expr("if(patient_id = 450, cast(raise_error('broken') as int), wait_days)")
    )
    with pytest.raises(Exception, match="broken"):
        W.add_batch(queue, broken)
    found = W.open_queue(spark, queue.folder, rows_in_bucket=100)
    assert found == queue
    same(spark, W.add_batch(found, people(spark, 400, 500)), people(spark, 0, 500))
    assert W.open_queue(spark, queue.folder).batches == 2
    with pytest.raises(ValueError):
        W.open_queue(spark, f"{queue.folder}/none")
