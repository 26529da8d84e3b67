import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carequeue.operators import capacity as C
from carequeue.operators.rank import rank_rows, running_sums
from carequeue.operators.sampling import fixed_sample, preview, sample_key
from carequeue.operators.shared import shared_folder


def skewed(spark, n=20000):
    """A third of all rows share one key; some have none."""
    key = F.expr("if(id % 3 = 0, 0.5D, if(id % 50 = 1, null, (id * 7919 % 101) / 100D))")
    return spark.range(n).select(
        F.col("id").alias("patient_id"),
        key.alias("priority_score"),
        F.expr("cast(if(id % 3 = 0, 50, id * 31 % 29) as int)").alias("wait_days"),
    )


@pytest.mark.parametrize("merge_small", ["true", "false"])
def test_rank_equals_the_plain_window(spark, merge_small):
    df = skewed(spark)
    plain = Window.orderBy(
        F.desc_nulls_last("priority_score"), F.desc_nulls_last("wait_days"), "patient_id"
    )
    expected = df.select("patient_id", F.row_number().over(plain).alias("expected"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge_small)
    try:
        ranked = C.queue_positions(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.count() == df.count()
    assert ranked.join(expected, "patient_id").where("queue_position <> expected").count() == 0


def test_hot_key_is_split_over_sort_partitions(spark):
    # so little data would otherwise be sorted in one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = os.path.dirname(C.queue_positions(skewed(spark)).inputFiles()[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = spark.read.parquet(stored).where("priority_score = 0.5 and wait_days = 50")
    sizes = [r["count"] for r in hot.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20000 / 4


def test_only_the_counts_meet_in_one_partition(spark):
    plan = C.queue_positions(skewed(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1
    after = plan[plan.index("SinglePartition"):]
    assert "HashAggregate" in after and "patient_id" not in after


def test_rank_of_nothing_and_of_odd_names(spark):
    empty = spark.range(0).withColumnRenamed("id", "a b")
    assert rank_rows(empty, F.col("`a b`").asc()).count() == 0
    one = rank_rows(spark.range(3).withColumnRenamed("id", "a.b"), F.desc("`a.b`"), position="p")
    assert sorted(r[:] for r in one.collect()) == [(0, 3), (1, 2), (2, 1)]


def test_schedule_weeks(spark):
    df = C.capacity_schedule(skewed(spark, 1000), C.Scenario(1, 100, 15))
    weeks = df.groupBy("baseline_week").count().collect()
    assert {r["count"] for r in weeks} == {100} and len(weeks) == 10
    assert df.where("new_week > baseline_week").count() == 0
    assert df.agg(F.max("new_week")).first()[0] == 9  # 114 a week


def test_optimized_schedule_blends(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.0, 10), (2, 0.0, 1.0, 10), (3, 0.5, 0.0, 20), (4, 0.5, None, 90)],
        "patient_id long, priority_score double, readmit_risk double, wait_days int",
    )
    rows = C.optimize_schedule(df, weekly_capacity=2).orderBy("queue_position").collect()
    assert [r.patient_id for r in rows] == [3, 1, 2, 4]
    assert [r.scheduled_week for r in rows] == [1, 1, 2, 2]
    flipped = C.optimize_schedule(df, risk_weight=1.0).orderBy("queue_position").first()
    assert flipped.patient_id == 2


@pytest.mark.parametrize("size", [0, 1, 100, 4999, 5000, 6000])
def test_sample_is_exact_and_repeatable(spark, size):
    df = spark.range(5000).selectExpr("id * 13 + 5 as patient_id")
    kept = sorted(r[0] for r in fixed_sample(df, size).collect())
    ranked = df.orderBy(sample_key("patient_id", 42), "patient_id").limit(size)
    assert kept == sorted(r[0] for r in ranked.collect())
    assert len(kept) == min(size, 5000)


def test_sample_reads_its_rows_once_and_passes_few_on(spark):
    df = spark.range(100_000).selectExpr("id as patient_id", "id % 7 as note")
    plan = fixed_sample(df, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "WindowGroupLimit" in plan and "TakeOrdered" in plan
    assert plan.index("TakeOrdered") < plan.index("WindowGroupLimit")
    assert fixed_sample(df, 50).columns == ["patient_id", "note"]


def test_sample_depends_on_the_seed(spark):
    df = spark.range(5000).withColumnRenamed("id", "patient_id")
    first = {r[0] for r in fixed_sample(df, 500, seed=1).collect()}
    second = {r[0] for r in fixed_sample(df, 500, seed=1_000_000_007).collect()}
    assert len(first & second) < 150
    assert len({i // 500 for i in first}) == 10


def test_preview(spark):
    df = spark.range(100).withColumnRenamed("id", "patient_id")
    assert [r[0] for r in preview(df).collect()] == list(range(10))


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_running_sums_split_a_heavy_value(spark):
    rows = [("a", i, i % 7) for i in range(5000)] + [("b", 3, 1), ("b", 1, 4)]
    df = spark.createDataFrame(rows, "who string, at long, n long")
    found = running_sums(df, F.desc("at"), sums={"so_far": "n", "n": "n"}, by="who")
    got = {(r.who, r.at): (r.so_far, r.n) for r in found.collect()}
    assert len(got) == len(rows)
    for who in ("a", "b"):
        total = 0
        for _, at, n in sorted((r for r in rows if r[0] == who), key=lambda r: -r[1]):
            total += n
            assert got[who, at] == (total, total)
