"""Per-patient scores as column expressions over the normalized patient columns.

Terms are added in a fixed order: the truncation in ``wait_days`` and the thresholds on
the risk depend on the last bits of the double sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.functions.fixed_values import AGE_BINS, SPECIALTY_WEIGHTS
from carequeue.schema import has_staffing


def _weight_cases() -> str:
    cases = " ".join(f"when '{name}' then {weight}D" for name, weight in SPECIALTY_WEIGHTS.items())
    return f"case specialty {cases} else 0D end"


def priority_score() -> Column:
    return F.expr(
        f"""least(1D,
            if(age > 70, 0.15D, 0D)
            + if(los > 3, 0.15D, 0D)
            + if(cost_estimate > 5000, 0.15D, 0D)
            + {_weight_cases()}
            + case season when 'Winter' then 0.07D when 'Autumn' then 0.03D else 0D end)"""
    )


PATIENTS_PER_DOCTOR = "planned_count / (doctors_fte + 0.1D)"
PATIENTS_PER_NURSE = "planned_count / (nurses_fte + 0.1D)"


def readmit_risk(staffing: bool) -> Column:
    """Readmission risk; ``staffing`` says whether the staffing columns exist."""
    workload = f"""
            + if({PATIENTS_PER_DOCTOR} > 60, 0.1D, 0D)
            + if({PATIENTS_PER_NURSE} > 30, 0.1D, 0D)"""
    # ``least`` skips NULL, so a missing cancellation risk is kept out of it
    return F.expr(
        f"""if(cancel_risk is null, null, least(1D,
            if(age > 70, 0.2D, 0D)
            + if(los > 5, 0.2D, 0D)
            + 0.2D * cancel_risk
            + if(cost_estimate > 6000, 0.2D, 0D)
            + if(season = 'Winter', 0.2D, 0D)
            {workload if staffing else ""}))"""
    )


def spread(key: str, modulus: int, seed: int = 42) -> Column:
    """Repeatable stand-in for a random integer in [0, modulus), keyed by a row id."""
    return F.expr(f"cast(pmod(pmod({key}, {modulus}) * 7919 + {seed}, {modulus}) as int)")


def wait_days() -> Column:
    """Days waited: falls with priority, plus a per-patient spread of 0..30 days."""
    return F.expr("cast(100 - priority_score * 100 as int)") + spread("patient_id", 31)


def combined_score(risk_weight: float) -> Column:
    return F.col("priority_score") * F.lit(1 - risk_weight) + F.col("readmit_risk") * F.lit(
        risk_weight
    )


def potential_cancellation_loss() -> Column:
    return F.col("cost_estimate") * F.col("cancel_risk")


def age_group(age: str = "age") -> Column:
    """Name of the age bin; 0 and ages above the last bin have none."""
    cases = " ".join(
        f"when {age} > {low} and {age} <= {high} then '{name}'" for low, high, name in AGE_BINS
    )
    return F.expr(f"case {cases} end")


def age_group_order(group: Column) -> Column:
    names = F.array(*[F.lit(name) for _, _, name in AGE_BINS])
    return F.array_position(names, group)


def to_percent(probability: Column) -> Column:
    return F.bround(probability * 100, 2)


def with_staffing_ratios(df: DataFrame) -> DataFrame:
    total = (
        "planned_count / (total_fte + 0.1D)" if "total_fte" in df.columns else PATIENTS_PER_DOCTOR
    )
    return df.withColumns(
        {
            "patients_per_doctor": F.expr(PATIENTS_PER_DOCTOR),
            "patients_per_nurse": F.expr(PATIENTS_PER_NURSE),
            "total_staff_efficiency": F.expr(total),
        }
    )


def with_efficiency_label(df: DataFrame) -> DataFrame:
    """Add the staffing ratios and the label the classifier learns.

    Without staffing columns the label rests on the readmission risk and the ratios are
    constants.
    """
    if has_staffing(df):
        df = with_staffing_ratios(df)
        efficient = F.expr(
            "cancel_risk < 0.05D and patients_per_doctor < 70 and patients_per_nurse < 35"
        )
    else:
        df = df.withColumns(
            {
                "patients_per_doctor": F.lit(50.0),
                "patients_per_nurse": F.lit(25.0),
                "total_staff_efficiency": F.lit(0.3),
            }
        )
        efficient = F.col("readmit_risk") < 0.3
    return df.withColumn("efficiency_label", F.when(efficient, 1).otherwise(0))


def score_patients(df: DataFrame) -> DataFrame:
    """Add priority score, readmission risk and wait days. Works on streams as well."""
    return df.withColumns(
        {"priority_score": priority_score(), "readmit_risk": readmit_risk(has_staffing(df))}
    ).withColumn("wait_days", wait_days())
