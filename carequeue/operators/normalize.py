"""Bring both input layouts, and one-hot tables, into the patient columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carequeue.functions import fixed_values as V
from carequeue.functions.scoring import spread
from carequeue.operators.rank import rank_rows
from carequeue.schema import one_hot_columns


def rename_specialty() -> Column:
    cases = " ".join(f"when '{old}' then '{new}'" for old, new in V.SPECIALTY_RENAMES.items())
    return F.expr(f"case specialty {cases} else specialty end")


def to_number(value: Column, type_name: str = "double") -> Column:
    """Number in a text column; text that is no number becomes NULL."""
    return value.try_cast(type_name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares above every number in Spark; a missing value must not."""
    doubles = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in doubles})


def parse_age_band(df: DataFrame) -> DataFrame:
    """Add the bounds of bands such as ``18-34`` and ``85+``."""
    parts = F.split(F.replace(F.col("age_band"), F.lit("+"), F.lit("")), "-")
    return df.withColumns(
        {
            "age_min": to_number(F.element_at(parts, 1), "int"),
            "age_max": F.when(
                F.contains("age_band", F.lit("+")), F.lit(V.OPEN_BAND_MAX_AGE)
            ).otherwise(to_number(F.element_at(parts, -1), "int")),
        }
    )


def age_within_band() -> Column:
    """Age inside the band, spread evenly and repeatably by patient."""
    return F.expr(
        """cast(age_min + pmod(pmod(patient_id, 1000003) * 7919 + 42, age_max - age_min + 1)
           as int)"""
    )


def add_patient_ids(df: DataFrame, *order: Column | str) -> DataFrame:
    """Number the rows 1..n in the order of the given columns (all columns if none)."""
    keys = [F.col(c) if isinstance(c, str) else c for c in (order or df.columns)]
    return rank_rows(df, *[k.asc_nulls_last() for k in keys], position="patient_id")


def normalize_patients(df: DataFrame, *id_order: Column | str) -> DataFrame:
    """Patient columns from either layout: with ages and ids, or with age bands.

    ``id_order`` decides the numbering where the input has no ``patient_id``.
    """
    df = nan_to_null(df)
    numbered = "patient_id" in df.columns and "age" in df.columns
    if "patient_id" not in df.columns:
        df = add_patient_ids(df, *id_order)
    if "age" in df.columns:
        df = df.withColumns({"age_min": F.col("age"), "age_max": F.col("age")})
    elif "age_band" in df.columns:
        df = parse_age_band(df)
        df = df.withColumn("age", age_within_band())
    else:
        df = df.withColumn("age", F.lit(V.DEFAULT_AGE))
    df = df.withColumn("specialty", rename_specialty())
    seasons = F.array(*[F.lit(s) for s in V.SEASONS])
    # without planned patients the layout with age bands has no staffing terms
    planned = {"planned_count": F.lit(V.DEFAULT_PLANNED_COUNT)} if numbered else {}
    defaults = {
        **planned,
        "cancel_risk": F.lit(V.DEFAULT_CANCEL_RISK),
        "los": F.lit(V.DEFAULT_LOS),
        "cost_estimate": F.lit(V.DEFAULT_COST),
        "season": F.element_at(seasons, spread("patient_id", 4) + 1),
    }
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def labels_from_one_hot(df: DataFrame) -> DataFrame:
    """Fill specialty, gender and season from one-hot columns where they are missing.

    A label column that holds any value stays as it is; one aggregate over the label
    columns present tells whether it does.
    """
    labels = ["specialty", "gender", "season"]
    present = [c for c in labels if c in df.columns]
    kept = {c: F.lit(False) for c in labels}
    if present:
        row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in present]).first()
        kept = {c: F.lit(c in present and bool(row[c])) for c in labels}

    def first_set(prefix: str, default: str) -> Column:
        named = [
            F.when(F.col(f"`{c}`") == 1, F.lit(c.removeprefix(prefix)))
            for c in one_hot_columns(df.columns, prefix)
        ]
        return F.coalesce(*named, F.lit(default))

    def pick(names: list[str]) -> Column:
        at = spread("patient_id", len(names)) + 1
        return F.element_at(F.array(*[F.lit(n) for n in names]), at)

    has_season = bool(one_hot_columns(df.columns, "season_"))
    rebuilt = {
        "specialty": first_set("specialty_", V.DEFAULT_SPECIALTY),
        "gender": (
            F.when(F.col("gender_M") == 1, "M").when(F.col("gender_M") == 0, "F")
            if "gender_M" in df.columns
            else pick(["M", "F"])
        ),
        "season": first_set("season_", V.DEFAULT_SEASON) if has_season else pick(V.SEASONS),
    }
    return df.withColumns(
        {
            c: F.when(kept[c], F.col(c)).otherwise(rebuilt[c]) if c in present else rebuilt[c]
            for c in labels
        }
    )
