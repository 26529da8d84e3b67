import datetime

import pytest
from pyspark.sql import functions as F

from carequeue.functions.calendar import previous_season, season_of_date
from carequeue.operators import normalize as N
from carequeue.schema import AGE_BAND_SCHEMA, SCORED_COLUMNS, validate_patients


def test_layout_with_ages(patients):
    raw = patients(
        {"specialty": "Trauma & Orthopaedics", "age": 33},
        {"specialty": "Hepatobiliary & Pancreatic Surgery"},
        {"specialty": None},
    )
    rows = N.normalize_patients(raw).orderBy("patient_id").collect()
    assert [r.specialty for r in rows] == ["Orthopedics", "Hepatobiliary Surgery", None]
    assert (rows[0].age_min, rows[0].age_max) == (33, 33)


def test_missing_columns_get_defaults(patients):
    raw = patients({}, {}, {}, {}, {}).select("patient_id", "age", "specialty")
    rows = N.normalize_patients(raw).orderBy("patient_id").collect()
    assert {(r.planned_count, r.cancel_risk, r.los, r.cost_estimate) for r in rows} == {
        (100, 0.03, 3.0, 3000.0)
    }
    assert len({r.season for r in rows[:4]}) == 4
    again = N.normalize_patients(raw).orderBy("patient_id").collect()
    assert rows == again


def test_layout_with_age_bands(spark):
    bands = ["18-34", "85+", "0-17", None, "odd"]
    names = [f.name for f in AGE_BAND_SCHEMA.fields]
    rows = [tuple({"age_band": b, "los": float(i)}.get(n) for n in names)
            for i, b in enumerate(bands)]
    df = spark.createDataFrame(rows, AGE_BAND_SCHEMA)
    out = N.normalize_patients(df, "los").orderBy("patient_id").collect()
    assert [r.patient_id for r in out] == [1, 2, 3, 4, 5]
    assert [(r.age_min, r.age_max) for r in out] == [
        (18, 34), (85, 95), (0, 17), (None, None), (None, None),
    ]
    for r in out[:3]:
        assert r.age_min <= r.age <= r.age_max
    assert out[3].age is None


def test_band_ages_cover_the_band(spark):
    df = spark.range(200).selectExpr("id as patient_id", "'18-34' as age_band")
    ages = {r.age for r in N.parse_age_band(df).select(N.age_within_band().alias("age")).collect()}
    assert ages == set(range(18, 35))


def test_no_age_at_all_is_fifty(patients):
    raw = patients({}).drop("age")
    assert N.normalize_patients(raw).first().age == 50


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(N.to_number(F.col("v"))).collect()] == [1.5, None, None]


def test_labels_from_one_hot(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 1, 0, 1), (2, 0, 1, 0, 1, 0), (3, 0, 0, None, 0, 0), (4, 1, 1, 1, 1, 1)],
        "patient_id long, specialty_ENT int, `specialty_General Medicine` int, gender_M int,"
        " season_Spring int, season_Winter int",
    )
    rows = N.labels_from_one_hot(df).orderBy("patient_id").collect()
    assert [r.specialty for r in rows] == ["ENT", "General Medicine", "General Surgery", "ENT"]
    assert [r.gender for r in rows] == ["M", "F", None, "M"]
    assert [r.season for r in rows] == ["Winter", "Spring", "Autumn", "Spring"]


def test_cleaned_name_is_no_one_hot_column(spark):
    df = spark.createDataFrame(
        [(1, "ENT", None)], "patient_id long, specialty_clean string, specialty string"
    )
    assert N.labels_from_one_hot(df).first().specialty == "General Surgery"


def test_labels_with_any_value_are_kept(spark):
    df = spark.createDataFrame(
        [(1, "ENT", None, 1), (2, None, None, 0)],
        "patient_id long, specialty string, gender string, gender_M int",
    )
    rows = N.labels_from_one_hot(df).orderBy("patient_id").collect()
    assert [r.specialty for r in rows] == ["ENT", None]
    assert [r.gender for r in rows] == ["M", "F"]
    assert all(r.season in ("Winter", "Spring", "Summer", "Autumn") for r in rows)


def test_season_of_every_month(spark):
    days = [(datetime.date(2024, m, 15),) for m in range(1, 13)]
    df = spark.createDataFrame(days, "day date")
    seasons = [r[0] for r in df.select(season_of_date("day")).collect()]
    assert seasons == (
        ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]
    )


def test_previous_season(spark):
    df = spark.createDataFrame([("Winter",), ("Spring",), ("Autumn",), ("x",)], "s string")
    before = [r[0] for r in df.select(previous_season(F.col("s"))).collect()]
    assert before == ["Autumn", "Winter", "Summer", None]


def test_validation(patients):
    assert validate_patients(None)[0] is False
    ok, message = validate_patients(patients({}))
    assert not ok and "priority_score" in message and "los" not in message
    full = patients({})
    for c in SCORED_COLUMNS:
        if c not in full.columns:
            full = full.withColumn(c, F.lit(0.0))
    assert validate_patients(full)[0] is True
    assert validate_patients(full.where("false"))[0] is False
    assert validate_patients(patients({}), ["age"])[0] is True


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_ids_are_one_to_n(spark, n):
    df = spark.range(n).selectExpr("id * 7 as v")
    ids = sorted(r.patient_id for r in N.add_patient_ids(df, "v").collect())
    assert ids == list(range(1, n + 1))


def test_bands_without_planned_count_have_no_staffing_terms(spark):
    from carequeue.functions.scoring import score_patients
    from carequeue.operators.normalize import normalize_patients

    row = (1, "65-84", "ENT", "Summer", 1.0, 1000.0, 0.1, 1.0, 1.0, 2.0)
    names = "patient_id age_band specialty season los cost_estimate cancel_risk doctors_fte nurses_fte total_fte"
    bands = spark.createDataFrame([row], names.split())
    scored = score_patients(normalize_patients(bands).withColumn("age", F.lit(60))).first()
    assert round(scored.readmit_risk, 6) == 0.02


def test_double_flags_with_spaces_in_names(spark):
    from carequeue.operators.normalize import nan_to_null

    df = spark.createDataFrame([(1.0,), (float("nan"),)], ["specialty_General Surgery"])
    assert [r[0] for r in nan_to_null(df).collect()] == [1.0, None]
