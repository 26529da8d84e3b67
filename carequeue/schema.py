"""Schemas of the patient table and the check that a scored table is complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COLUMN_TYPES: dict[str, T.DataType] = {
    "patient_id": T.LongType(),
    "age": T.IntegerType(),
    "age_band": T.StringType(),
    "specialty": T.StringType(),
    "specialty_clean": T.StringType(),
    "gender": T.StringType(),
    "season": T.StringType(),
    "los": T.DoubleType(),
    "cost_estimate": T.DoubleType(),
    "cancel_risk": T.DoubleType(),
    "planned_count": T.IntegerType(),
    "doctors_fte": T.DoubleType(),
    "nurses_fte": T.DoubleType(),
    "total_fte": T.DoubleType(),
}

ONE_HOT_PREFIXES = ("specialty_", "season_", "gender_")

SCORED_COLUMNS = [
    "patient_id",
    "age",
    "cancel_risk",
    "los",
    "cost_estimate",
    "priority_score",
    "readmit_risk",
    "wait_days",
]

STAFFING_COLUMNS = ["doctors_fte", "nurses_fte", "planned_count"]


def one_hot_columns(columns: Sequence[str], prefix: str) -> list[str]:
    """Names of the 0/1 columns of a label, in table order."""
    return [c for c in columns if c.startswith(prefix) and c not in COLUMN_TYPES]


def schema_of(columns: Sequence[str]) -> T.StructType:
    """Schema of a patient file with these header names; unknown names are strings."""

    def type_of(name: str) -> T.DataType:
        if name in COLUMN_TYPES:
            return COLUMN_TYPES[name]
        if name.startswith(ONE_HOT_PREFIXES):
            return T.IntegerType()
        return T.StringType()

    return T.StructType([T.StructField(name, type_of(name), True) for name in columns])


PATIENT_SCHEMA = schema_of([c for c in COLUMN_TYPES if c not in ("age_band", "specialty_clean")])
AGE_BAND_SCHEMA = schema_of(
    [c for c in COLUMN_TYPES if c not in ("patient_id", "age", "specialty_clean")]
)


def has_staffing(df: DataFrame) -> bool:
    """True when the staffing terms of the scores can be computed."""
    return set(STAFFING_COLUMNS) <= set(df.columns)


def validate_patients(
    df: DataFrame | None, required: Sequence[str] | None = None
) -> tuple[bool, str]:
    """Tell whether a table has rows and all required columns, with the reason if not."""
    if df is None:
        return False, "No table given"
    missing = [c for c in (required or SCORED_COLUMNS) if c not in df.columns]
    if missing:
        return False, f"Missing columns: {missing}"
    if df.isEmpty():
        return False, "The table is empty"
    return True, "All required columns are present"
