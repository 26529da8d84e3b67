"""Grouped reports over scored patients.

Groups are specialties, seasons and age bins: partial aggregation on the map side leaves a
few rows per task, so a heavy group costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V
from carequeue.functions import scoring as S
from carequeue.functions.calendar import previous_season
from carequeue.functions.exact import mean, total

HIGH_RISK = 0.7


def _keep(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    return df.where(F.col(column).isin(list(values))) if values else df


def _by(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def _patients(alias: str = "patient_count") -> Column:
    return F.count("patient_id").alias(alias)


def _sum(column: str | Column) -> Column:
    """Sum that is 0 when there is nothing to add."""
    return F.coalesce(total(column), F.lit(0.0))


# -- filters -------------------------------------------------------------------------


def high_risk_patients(df: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    """Patients above the risk threshold, highest risk first."""
    return df.where(F.col("readmit_risk") > threshold).orderBy(
        F.desc("readmit_risk"), "patient_id"
    )


def filter_ages(
    df: DataFrame,
    age: int | None = None,
    age_min: int | None = None,
    age_max: int | None = None,
    age_group: str | None = None,
    specialties: Sequence[str] | None = None,
) -> DataFrame:
    """Patients of an exact age, else of an age range, else of a named age group."""
    column = F.col("age")
    bounds = {word: (low, high) for word, low, high in V.AGE_WORDS}
    if age is not None:
        df = df.where(column == age)
    elif age_min is not None and age_max is not None:
        df = df.where(column.between(age_min, age_max))
    elif age_group in ("elderly", "senior"):
        df = df.where(column >= bounds[age_group][0])  # named alone, there is no upper end
    elif age_group in bounds:
        df = df.where(column.between(*bounds[age_group]))
    return _keep(df, "specialty", specialties)


# -- by specialty --------------------------------------------------------------------


def average_wait_time(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    return _by(
        _keep(df, "specialty", specialties),
        "specialty",
        F.avg("wait_days").alias("avg_wait_days"),
        _patients(),
    ).orderBy("specialty")


def specialty_analysis(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    return _by(
        _keep(df, "specialty", specialties),
        "specialty",
        _patients(),
        F.avg("wait_days").alias("avg_wait_days"),
        mean("cost_estimate").alias("avg_cost"),
        mean("cancel_risk").alias("avg_cancel_risk"),
        mean("readmit_risk").alias("avg_readmit_risk"),
    ).orderBy("specialty")


def specialty_performance(df: DataFrame) -> DataFrame:
    """Specialty analysis rounded to two decimals."""
    report = specialty_analysis(df)
    averages = [c for c in report.columns if c.startswith("avg_")]
    return report.withColumns({c: F.bround(c, 2) for c in averages})


def high_risk_by_specialty(
    df: DataFrame, percentage: float = V.DEFAULT_RISK_PERCENTAGE,
    specialties: Sequence[str] | None = None,
) -> DataFrame:
    return _by(
        _keep(df.where(F.col("readmit_risk") > percentage / 100), "specialty", specialties),
        "specialty",
        _patients("high_risk_count"),
        mean("readmit_risk").alias("avg_risk"),
        mean("cost_estimate").alias("avg_cost"),
    ).orderBy("specialty")


def cost_impact(df: DataFrame, specialties: Sequence[str] | None = None) -> DataFrame:
    return _by(
        _keep(df, "specialty", specialties),
        "specialty",
        _sum("cost_estimate").alias("total_cost"),
        mean("cost_estimate").alias("avg_cost"),
        F.count("cost_estimate").alias("patient_count"),
        _sum(S.potential_cancellation_loss()).alias("potential_loss_from_cancellations"),
    ).orderBy("specialty")


def specialty_counts(df: DataFrame) -> DataFrame:
    return _by(df, "specialty", F.count("*").alias("patient_count")).orderBy(
        F.desc("patient_count"), "specialty"
    )


def wait_ranking(df: DataFrame) -> DataFrame:
    return _by(df, "specialty", F.avg("wait_days").alias("avg_wait_days")).orderBy(
        F.desc("avg_wait_days"), "specialty"
    )


def cancel_ranking(df: DataFrame) -> DataFrame:
    return _by(df, "specialty", mean("cancel_risk").alias("avg_cancel_risk")).orderBy(
        F.desc("avg_cancel_risk"), "specialty"
    )


def top_specialty(df: DataFrame) -> DataFrame:
    """Most frequent specialty; the first by name where several are."""
    return specialty_counts(df).limit(1)


def highest_risk_specialty(df: DataFrame) -> DataFrame:
    return (
        _by(df, "specialty", mean("readmit_risk").alias("avg_readmit_risk"))
        .orderBy(F.desc("avg_readmit_risk"), "specialty")
        .limit(1)
    )


# -- by season -----------------------------------------------------------------------


def seasonal_analysis_basic(
    df: DataFrame, specialties: Sequence[str] | None = None
) -> DataFrame:
    return _by(
        _keep(df, "specialty", specialties),
        "season",
        mean("cancel_risk").alias("avg_cancel_risk"),
        _patients("total_cases"),
    ).orderBy(F.desc("avg_cancel_risk"), "season")


def seasonal_analysis(
    df: DataFrame,
    seasons: Sequence[str] | None = None,
    specialties: Sequence[str] | None = None,
) -> DataFrame:
    return _by(
        _keep(_keep(df, "season", seasons), "specialty", specialties),
        "season",
        mean("cancel_risk").alias("avg_cancel_risk"),
        mean("readmit_risk").alias("avg_readmit_risk"),
        mean("cost_estimate").alias("avg_cost"),
        _patients("total_cases"),
    ).orderBy(F.desc("avg_cancel_risk"), "season")


def _all_seasons(report: DataFrame) -> DataFrame:
    """One row per season in alphabetical order, 0 where the report has none."""
    spark = report.sparkSession
    names = spark.createDataFrame([(s,) for s in sorted(V.SEASONS)], "season string")
    measures = [c for c in report.columns if c != "season"]
    # the report holds one row per season name
    return (
        names.join(report, "season", "left")
        .select("season", *[F.coalesce(c, F.lit(0)).alias(c) for c in measures])
        .orderBy("season")
    )


def season_counts(df: DataFrame) -> DataFrame:
    return _all_seasons(_by(df, "season", F.count("*").alias("patient_count")))


def season_risk(df: DataFrame) -> DataFrame:
    return _all_seasons(
        _by(
            df,
            "season",
            F.bround(mean("cancel_risk"), 3).alias("avg_cancel_risk"),
            F.bround(mean("readmit_risk"), 3).alias("avg_readmit_risk"),
        )
    )


def season_cost_delta(df: DataFrame, current: str | None = None) -> DataFrame:
    """Cost of a season less that of the season before it, for one or every season.

    Where one of the two seasons has no patients, a tenth of the whole cost is shown
    instead and the row is marked.
    """
    whole = _sum("cost_estimate").alias("total")
    if "season" in df.columns:
        sums = [
            total(F.when(F.col("season") == s, F.coalesce("cost_estimate", F.lit(0.0)))).alias(s)
            for s in V.SEASONS
        ]
    else:
        sums = [F.lit(None).cast("double").alias(s) for s in V.SEASONS]
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("current_season"), F.col(s).alias("current_cost"))
            for s in V.SEASONS
            if current in (None, s)
        ]
    )
    costs = F.create_map(*[x for s in V.SEASONS for x in (F.lit(s), F.col(s))])
    return (
        df.agg(whole, *sums)
        .select("total", costs.alias("costs"), F.inline(rows))
        .withColumn("previous_season", previous_season(F.col("current_season")))
        .withColumn("previous_cost", F.element_at("costs", F.col("previous_season")))
        .withColumn(
            "is_fallback", F.col("current_cost").isNull() | F.col("previous_cost").isNull()
        )
        .withColumn(
            "cost_delta",
            F.when(F.col("is_fallback"), F.col("total") / 10).otherwise(
                F.col("current_cost") - F.col("previous_cost")
            ),
        )
        .select(
            "current_season",
            "previous_season",
            "current_cost",
            "previous_cost",
            "cost_delta",
            "is_fallback",
            F.concat(
                F.when(F.col("cost_delta") >= 0, "+£").otherwise("£"),
                F.call_function("format_number", F.col("cost_delta") / 1000000, F.lit("0.0")),
                F.lit("M "),
                F.when(F.col("is_fallback"), "this quarter").otherwise(
                    F.concat(F.lit("from "), F.col("previous_season"))
                ),
            ).alias("delta_text"),
        )
    )


# -- by age --------------------------------------------------------------------------


def _by_age_group(df: DataFrame, *aggregates: Column) -> DataFrame:
    return _by(df.withColumn("age_group", S.age_group()), "age_group", *aggregates)


def age_based_risk(df: DataFrame, **ages) -> DataFrame:
    """Readmission risk by age bin, youngest first. Keywords as in ``filter_ages``."""
    return _by_age_group(
        filter_ages(df, **ages),
        mean("readmit_risk").alias("avg_readmit_risk"),
        _patients("total_patients"),
    ).orderBy(S.age_group_order(F.col("age_group")))


def age_based_cancellation(df: DataFrame, **ages) -> DataFrame:
    return _by_age_group(
        filter_ages(df, **ages),
        mean("cancel_risk").alias("avg_cancel_risk"),
        _patients("total_patients"),
    ).orderBy(F.desc("avg_cancel_risk"), S.age_group_order(F.col("age_group")))


def age_based_cost(df: DataFrame, **ages) -> DataFrame:
    return _by_age_group(
        filter_ages(df, **ages).where(F.col("cost_estimate").isNotNull()),
        mean("cost_estimate").alias("avg_cost"),
        total("cost_estimate").alias("total_cost"),
        F.count("cost_estimate").alias("patient_count"),
    ).orderBy(F.desc("avg_cost"), S.age_group_order(F.col("age_group")))


# -- whole table ---------------------------------------------------------------------


def overview_kpis(df: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_patients"),
        F.avg("wait_days").alias("avg_wait_days"),
        F.count_if(F.col("readmit_risk") > threshold).alias("high_risk_patients"),
        _sum("cost_estimate").alias("total_cost"),
        F.avg("age").alias("avg_age"),
        F.count_if(F.col("season") == "Winter").alias("winter_patients"),
    )


def risk_histogram(df: DataFrame, bins: int = 20, threshold: float = HIGH_RISK) -> DataFrame:
    """Patients per equal-width bin of readmission risk; 1.0 falls into the last bin."""
    width = 1 / bins
    at = F.least(F.floor(F.col("readmit_risk") / width), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col("readmit_risk").isNotNull())
        .groupBy(at.alias("bin"))
        .agg(
            F.count("*").alias("patient_count"),
            F.count_if(F.col("readmit_risk") > threshold).alias("above_threshold"),
        )
        .select("bin", (F.col("bin") * width).alias("bin_start"), "patient_count", "above_threshold")
        .orderBy("bin")
    )


def column_profile(
    df: DataFrame, columns: Sequence[str] = ("specialty", "gender", "season")
) -> DataFrame:
    """Distinct values and non-null rows of label columns, one row per column.

    Each distinct pair of column and value is counted first, on the map side.
    """
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    )
    return (
        df.select(pairs)
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(
            F.count("value").alias("distinct_values"),
            _sum_if(F.col("value").isNotNull(), "n").alias("non_null"),
            (_sum_if(F.col("value").isNotNull(), "n") == 0).alias("all_null"),
        )
    )


def _sum_if(condition: Column, column: str) -> Column:
    return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0)))


def label_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("efficiency_label").alias("efficiency_rate"), F.count("*").alias("patient_count")
    )


def high_risk_summary(df: DataFrame, percentage: float = V.DEFAULT_RISK_PERCENTAGE) -> DataFrame:
    threshold = percentage / 100
    high = F.col("readmit_risk") > threshold
    count = F.count_if(high)
    return df.agg(
        count.alias("high_risk_patient_count"),
        F.lit(threshold).alias("risk_threshold"),
        F.bround(F.coalesce(mean(F.when(high, F.col("cost_estimate"))), F.lit(0.0)), 2).alias(
            "avg_cost_high_risk"
        ),
        (count > 0).alias("potential_intervention_needed"),
    )


def cancellation_whatif(
    df: DataFrame, percentages: Sequence[float] = (V.DEFAULT_PERCENTAGE,), by: Sequence[str] = ()
) -> DataFrame:
    """What fewer cancellations would save, per reduction and optionally per group."""
    totals = df.groupBy(*by).agg(
        _sum("cancel_risk").alias("expected"),
        mean("cost_estimate").alias("avg_cost"),
        mean("los").alias("avg_los"),
    )
    reductions = F.explode(F.array(*[F.lit(float(p)) for p in percentages]))
    prevented = F.col("expected") * (F.col("reduction_percentage") / 100)
    bed_days = prevented * F.col("avg_los")
    return totals.select("*", reductions.alias("reduction_percentage")).select(
        *by,
        "reduction_percentage",
        F.bround("expected", 2).alias("current_expected_cancellations"),
        F.bround(prevented, 2).alias("cancellations_prevented"),
        F.bround(prevented * F.col("avg_cost"), 2).alias("cost_savings"),
        F.bround(bed_days, 2).alias("bed_days_freed"),
        F.bround(bed_days / 7 * 5, 2).alias("weekly_capacity_freed"),
    )


# -- dimension join ------------------------------------------------------------------


def specialty_dimension(df: DataFrame) -> DataFrame:
    """Fixed dimension of raw specialty names: reported name and priority weight."""
    from carequeue.sources.tables import RAW_SPECIALTIES

    rows = [
        (raw, name, V.SPECIALTY_WEIGHTS.get(name, 0.0))
        for raw in RAW_SPECIALTIES
        for name in [V.SPECIALTY_RENAMES.get(raw, raw)]
    ]
    return df.sparkSession.createDataFrame(rows, "specialty string, name string, weight double")


def join_specialty_dimension(raw: DataFrame) -> DataFrame:
    """Raw patients with reported name and weight; unknown names stay, with weight 0."""
    dimension = F.broadcast(specialty_dimension(raw))  # 18 rows
    return raw.join(dimension, "specialty", "left").withColumns(
        {
            "name": F.coalesce("name", "specialty"),
            "weight": F.coalesce("weight", F.lit(0.0)),
        }
    )
