"""Properties that hold for any waiting list, checked on generated and given patients."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carequeue.functions.fixed_values import SEASONS, SPECIALTY_WEIGHTS
from carequeue.functions.scoring import score_patients
from carequeue.operators import capacity as C
from carequeue.operators import reports as R
from carequeue.operators.normalize import normalize_patients
from carequeue.plans.registry import scored

SLOW = settings(
    max_examples=5,
    deadline=datetime.timedelta(minutes=2),
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
number = st.one_of(st.none(), st.floats(0, 20000, allow_nan=False), st.just(float("nan")))
patient = st.fixed_dictionaries(
    {
        "age": st.one_of(st.none(), st.integers(0, 130)),
        "specialty": st.one_of(st.none(), st.sampled_from([*SPECIALTY_WEIGHTS, "Other"])),
        "season": st.one_of(st.none(), st.sampled_from(SEASONS)),
        "los": number,
        "cost_estimate": number,
        "cancel_risk": st.one_of(st.none(), st.floats(0, 1)),
        "planned_count": st.integers(0, 5000),
        "doctors_fte": st.floats(0, 50),
    }
)


@SLOW
@given(rows=st.lists(patient, min_size=1, max_size=40))
def test_scores_stay_in_range(patients, rows):
    df = score_patients(normalize_patients(patients(*rows)))
    outside = "priority_score not between 0 and 1 or readmit_risk not between 0 and 1"
    assert df.where(outside).count() == 0
    assert df.where("priority_score is null").count() == 0
    assert df.where("(readmit_risk is null) <> (cancel_risk is null)").count() == 0
    assert df.where("wait_days not between 0 and 130").count() == 0


@SLOW
@given(rows=st.lists(patient, min_size=1, max_size=40))
def test_group_counts_add_up(patients, rows):
    df = score_patients(normalize_patients(patients(*rows)))
    for report, key, count in [
        (R.specialty_analysis, "specialty", "patient_count"),
        (R.seasonal_analysis, "season", "total_cases"),
    ]:
        total = report(df).agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
        assert total == df.where(f"{key} is not null").count()


@pytest.fixture(scope="module")
def given_patients(spark):
    df = scored(spark, "/root/testdata/sf0.001").cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("schedule", [C.capacity_schedule, C.optimize_schedule])
def test_positions_are_one_to_n(given_patients, schedule):
    found = schedule(given_patients).agg(
        F.min("queue_position"), F.max("queue_position"), F.count_distinct("queue_position")
    ).first()
    n = given_patients.count()
    assert found[:] == (1, n, n)


def test_more_capacity_never_takes_longer(given_patients):
    scenarios = [C.Scenario(i, 40, 5 * i) for i in range(21)]
    report = C.capacity_impact(given_patients, scenarios).orderBy("scenario_id").collect()
    weeks = [r.new_weeks for r in report]
    moved = [r.patients_moved_earlier for r in report]
    assert weeks == sorted(weeks, reverse=True) and moved == sorted(moved)


def test_summary_agrees_with_the_schedule(given_patients):
    schedule = C.capacity_schedule(given_patients, C.Scenario(1, 40, 20))
    counted = schedule.agg(
        F.max("baseline_week"),
        F.max("new_week"),
        F.count_if(F.col("new_week") < F.col("baseline_week")),
        F.avg(F.col("baseline_week") - F.col("new_week")),
    ).first()
    row = C.capacity_impact(given_patients, [C.Scenario(1, 40, 20)]).first()
    assert counted[:3] == (row.baseline_weeks, row.new_weeks, row.patients_moved_earlier)
    assert counted[3] == pytest.approx(row.avg_weeks_saved)
    backlog = C.weekly_backlog(given_patients, [C.Scenario(1, 40, 20)]).collect()
    for r in backlog[::9]:
        assert r.baseline_backlog == schedule.where(f"baseline_week > {r.week}").count()
        assert r.new_backlog == schedule.where(f"new_week > {r.week}").count()
