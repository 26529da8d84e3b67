import math

import pytest
from pyspark.sql import functions as F

from carequeue.functions import scoring as S
from carequeue.operators.normalize import normalize_patients


def column(df, name):
    return [r[name] for r in df.orderBy("patient_id").select(name).collect()]


@pytest.mark.parametrize(
    "row, score",
    [
        ({}, 0.0),
        ({"age": 70}, 0.0),
        ({"age": 71}, 0.15),
        ({"los": 3.0}, 0.0),
        ({"los": 3.01}, 0.15),
        ({"cost_estimate": 5000.0}, 0.0),
        ({"cost_estimate": 5000.01}, 0.15),
        ({"specialty": "Cardiology"}, 0.15),
        ({"specialty": "General Surgery"}, 0.13),
        ({"specialty": "Urology"}, 0.11),
        ({"specialty": "Gynaecology"}, 0.09),
        ({"specialty": "Ophthalmology"}, 0.07),
        ({"specialty": "Orthopedics"}, 0.05),
        ({"specialty": "ENT"}, 0.03),
        ({"season": "Winter"}, 0.07),
        ({"season": "Autumn"}, 0.03),
        ({"season": "Spring"}, 0.0),
        ({"age": None, "los": None, "cost_estimate": None, "specialty": None, "season": None}, 0.0),
    ],
)
def test_priority_terms(patients, row, score):
    assert column(S.score_patients(patients(row)), "priority_score") == [score]


def test_priority_adds_terms_in_order(patients):
    everything = {
        "age": 80, "los": 9.0, "cost_estimate": 9000.0, "specialty": "Cardiology",
        "season": "Winter",
    }
    expected = 0.15 + 0.15 + 0.15 + 0.15 + 0.07
    assert column(S.score_patients(patients(everything)), "priority_score") == [expected]


def test_readmission_edges(patients):
    rows = [
        {"age": 71},
        {"los": 5.0},
        {"los": 5.01},
        {"cost_estimate": 6000.0},
        {"cost_estimate": 6000.01},
        {"season": "Winter"},
        {"cancel_risk": 0.5},
        {"planned_count": 607, "doctors_fte": 10.0, "nurses_fte": 90.0},
        {"planned_count": 604, "doctors_fte": 90.0, "nurses_fte": 20.0},
        {"cancel_risk": None},
        {"age": 80, "los": 9.0, "cost_estimate": 9000.0, "season": "Winter", "cancel_risk": 0.9,
         "planned_count": 9000},
    ]
    risks = column(S.score_patients(patients(*rows)), "readmit_risk")
    assert risks == [0.2, 0.0, 0.2, 0.0, 0.2, 0.2, 0.1, 0.1, 0.1, None, 1.0]


def test_staffing_terms_need_staffing_columns(patients):
    busy = patients({"planned_count": 9000}, drop=["nurses_fte"])
    assert column(S.score_patients(busy), "readmit_risk") == [0.0]


def test_wait_days_truncate(patients):
    # 100 - 0.15*100 and 100 - 0.57*100 in doubles
    rows = [{"patient_id": 31, "age": 71}, {"patient_id": 62}]
    waits = column(S.score_patients(patients(*rows)), "wait_days")
    assert waits == [int(100 - 0.15 * 100) + 42 % 31, 100 + 42 % 31]


def test_wait_days_spread_is_whole_range(spark):
    ids = spark.range(31).withColumn("priority_score", F.lit(0.0))
    ids = ids.withColumnRenamed("id", "patient_id")
    days = {r[0] for r in ids.select(S.wait_days()).collect()}
    assert days == set(range(100, 131))


def test_age_bins_are_closed_on_the_right(spark):
    ages = [0, 1, 17, 18, 35, 36, 60, 61, 120, 121, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    groups = [r[0] for r in df.select(S.age_group()).collect()]
    assert groups == [
        None, "Child", "Child", "Young Adult", "Young Adult", "Adult", "Adult", "Elderly",
        "Elderly", None, None,
    ]


def test_efficiency_label(patients):
    rows = [
        {"cancel_risk": 0.04, "planned_count": 100},
        {"cancel_risk": 0.05, "planned_count": 100},
        {"cancel_risk": 0.04, "planned_count": 708},
        {"cancel_risk": None},
    ]
    labelled = S.with_efficiency_label(S.score_patients(patients(*rows)))
    assert column(labelled, "efficiency_label") == [1, 0, 0, 0]
    assert column(labelled, "patients_per_doctor")[0] == 100 / 10.1
    assert column(labelled, "total_staff_efficiency")[0] == 100 / 30.1


def test_efficiency_label_without_staffing(patients):
    rows = [{}, {"age": 80, "los": 9.0}]
    bare = patients(*rows, drop=["doctors_fte", "nurses_fte", "total_fte"])
    labelled = S.with_efficiency_label(S.score_patients(bare))
    assert column(labelled, "efficiency_label") == [1, 0]
    assert labelled.select(*["patients_per_doctor", "patients_per_nurse",
                             "total_staff_efficiency"]).first()[:] == (50.0, 25.0, 0.3)


def test_ratio_without_total_staff_is_per_doctor(patients):
    df = S.with_staffing_ratios(patients({}, drop=["total_fte"]))
    assert column(df, "total_staff_efficiency") == [100 / 10.1]


def test_nan_is_missing_not_large(patients):
    rows = [{"los": math.nan, "cost_estimate": math.nan, "cancel_risk": math.nan}]
    scored = S.score_patients(normalize_patients(patients(*rows)))
    row = scored.first()
    assert (row.priority_score, row.readmit_risk, row.los) == (0.0, None, None)


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.12345,), (0.5,), (0.00125,)], "p double")
    assert [r[0] for r in df.select(S.to_percent(F.col("p"))).collect()] == [12.34, 50.0, 0.12]


def test_scores_of_an_empty_table(patients):
    empty = patients({}).where("false")
    assert S.score_patients(normalize_patients(empty)).count() == 0
