"""Patient table derived from order, customer and line item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions.calendar import season_of_date

# Names as they appear in raw input, by customer key modulo 18.
RAW_SPECIALTIES = [
    "Breast Surgery",
    "Cardiology",
    "Colorectal Surgery",
    "Dermatology",
    "ENT",
    "Gastroenterology",
    "General Surgery",
    "Gynaecology",
    "Maxillofacial Surgery",
    "Neurosurgery",
    "Ophthalmology",
    "Trauma & Orthopaedics",
    "Plastic Surgery",
    "Respiratory Medicine",
    "Rheumatology",
    "Urology",
    "Vascular Surgery",
    "Hepatobiliary & Pancreatic Surgery",
]


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_patients(spark: SparkSession, folder: str) -> DataFrame:
    """One patient per order, in the raw layout with ids and ages.

    Columns a query does not use are pruned down to the scans; when it needs neither the
    length of stay nor the cancellation risk, the line items are not read at all.
    """
    orders = load_table(spark, folder, "orders")
    customers = load_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    stays = (
        load_table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.avg("l_discount"), 6).alias("mean_discount"),
        )
    )
    names = F.array(*[F.lit(s) for s in RAW_SPECIALTIES])
    return (
        orders.join(customers, F.expr("o_custkey = c_custkey"))
        .join(stays, "o_orderkey", "left")
        .withColumns(
            {
                "specialty": F.element_at(names, F.expr("cast(o_custkey % 18 as int) + 1")),
                "season": season_of_date("o_orderdate"),
            }
        )
        .selectExpr(
            "o_orderkey as patient_id",
            "cast((o_orderkey * 31 + o_custkey * 17) % 96 as int) as age",
            "specialty",
            "if(o_orderkey % 2 = 0, 'F', 'M') as gender",
            "season",
            "cast(coalesce(n_lines, 0) as double) as los",
            "o_totalprice / 50D as cost_estimate",
            "coalesce(mean_discount, 0.03D) as cancel_risk",
            "cast(20 + o_custkey % 200 as int) as planned_count",
            "cast(1 + c_nationkey % 10 as double) as doctors_fte",
            "cast(2 + c_nationkey % 23 as double) as nurses_fte",
            "cast(3 + c_nationkey % 10 + c_nationkey % 23 as double) as total_fte",
        )
    )
