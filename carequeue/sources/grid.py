"""A regular grid of made-up patients for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions.fixed_values import SEASONS

# Grid specialties with length of stay, cost and cancellation risk.
GRID_SPECIALTIES = [
    ("Orthopedics", 3.8, 3800.0, 0.06),
    ("ENT", 1.7, 2200.0, 0.033),
    ("General Surgery", 4.2, 4200.0, 0.038),
    ("Gynaecology", 3.0, 3000.0, 0.03),
    ("Urology", 3.0, 3000.0, 0.03),
    ("Ophthalmology", 1.2, 1800.0, 0.012),
    ("Cardiology", 5.1, 5200.0, 0.018),
]
AGES = list(range(18, 91, 5))


def reference_grid(spark: SparkSession) -> DataFrame:
    """Every specialty, season, gender and age of the grid: 7 x 4 x 2 x 15 rows.

    An explicit generator; reading a missing file still raises.
    """
    n_ages, n_seasons = len(AGES), len(SEASONS)
    total = len(GRID_SPECIALTIES) * n_seasons * 2 * n_ages
    row = F.col("id")

    def digit(step: int, size: int) -> Column:
        return (F.floor(row / step) % size).cast("int")

    profiles = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(s).alias("los"), F.lit(c).alias("cost"),
                     F.lit(r).alias("risk"))
            for n, s, c, r in GRID_SPECIALTIES
        ]
    )
    return (
        spark.range(total)
        .withColumn("p", F.element_at(profiles, digit(2 * n_ages * n_seasons, total) + 1))
        .withColumn("age", (F.lit(AGES[0]) + digit(1, n_ages) * 5).cast("int"))
        .select(
            (row + 1).alias("patient_id"),
            "age",
            F.col("p.name").alias("specialty"),
            F.when(digit(n_ages, 2) == 0, "M").otherwise("F").alias("gender"),
            F.element_at(
                F.array(*[F.lit(s) for s in SEASONS]), digit(2 * n_ages, n_seasons) + 1
            ).alias("season"),
            F.col("p.los").alias("los"),
            F.col("p.cost").alias("cost_estimate"),
            F.col("p.risk").alias("cancel_risk"),
            F.lit(100).alias("planned_count"),
            F.lit(50.0).alias("doctors_fte"),
            F.lit(100.0).alias("nurses_fte"),
            F.lit(150.0).alias("total_fte"),
            F.col("age").alias("age_min"),
            F.col("age").alias("age_max"),
        )
    )
