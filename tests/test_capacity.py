import math

import pytest
from pyspark.sql import functions as F

from carequeue.operators import capacity as C
from carequeue.operators.capacity import Scenario

CASES = [
    (n, base, uplift)
    for n in [0, 1, 49, 50, 51, 99, 100, 101, 119, 120, 121, 240, 997, 1000, 1234]
    for base in [1, 7, 50, 100, 113]
    for uplift in [0, 1, 13, 15, 20, 57, 100, 250]
]


def by_position(n, base, new):
    """Week figures patient by patient."""
    old = [math.ceil(p / base) for p in range(1, n + 1)]
    later = [math.ceil(p / new) for p in range(1, n + 1)]
    moved = sum(b < a for a, b in zip(old, later))
    saved = sum(a - b for a, b in zip(old, later)) / n if n else 0.0
    return max(old, default=0), max(later, default=0), moved, saved


def by_week(n, base, new):
    """Places gained per week."""
    gained = 0
    for week in range(1, math.ceil(n / base) + 1):
        now = min(base, n - (week - 1) * base)
        then = min(new, n - (week - 1) * new)
        gained += max(0, then - now)
    return gained


@pytest.fixture(scope="module")
def figures(spark):
    cases = [(n, b, u, int(b * (1 + u / 100))) for n, b, u in CASES]
    df = spark.createDataFrame(
        cases,
        "total_patients long, baseline_capacity int, uplift_percentage int, expected_new int",
    )
    df = df.withColumn(
        "new_capacity", C._new_capacity(F.col("baseline_capacity"), F.col("uplift_percentage"))
    ).withColumn("additional_capacity", F.expr("new_capacity - baseline_capacity"))
    total, base, new = "total_patients", "baseline_capacity", "new_capacity"
    return df.select(
        "*",
        C._weeks(total, base).alias("old_weeks"),
        C._weeks(total, new).alias("new_weeks"),
        C._moved_earlier().alias("moved"),
        C._moved_places().alias("places"),
        (C._sum_of_weeks(total, base) - C._sum_of_weeks(total, new)).alias("saved"),
    ).collect()


def test_new_capacity_truncates(figures):
    assert all(r.new_capacity == r.expected_new for r in figures)
    assert {r.new_capacity for r in figures if (r.baseline_capacity, r.uplift_percentage) == (100, 15)} == {114}


def test_closed_forms_equal_counting(figures):
    for r in figures:
        n, base, new = r.total_patients, r.baseline_capacity, r.new_capacity
        old_weeks, new_weeks, moved, saved = by_position(n, base, new)
        assert (r.old_weeks, r.new_weeks, r.moved) == (old_weeks, new_weeks, moved), r
        assert r.saved == pytest.approx(saved * n)
        assert r.places == by_week(n, base, new), r


def test_impact_per_group(patients):
    df = patients(*[{"specialty": "ENT"}] * 5, *[{"specialty": "Urology"}] * 3)
    report = C.capacity_impact(df, [Scenario(1, 2, 50), Scenario(2, 2, 0)], ["specialty"])
    found = {(r.specialty, r.scenario_id): r for r in report.collect()}
    ent = found["ENT", 1]
    assert (ent.baseline_weeks, ent.new_weeks, ent.weeks_saved) == (3, 2, 1)
    assert ent.patients_moved_earlier == by_position(5, 2, 3)[2]
    assert found["Urology", 2].patients_moved_earlier == 0
    # five rows of 100 planned, ten doctors on average
    assert ent.patients_per_doctor == 50.0 and ent.additional_doctors_needed == 1 / 50
    assert ent.cost_mixed_scenario == pytest.approx(0.6 / 50 * 80000 + 0.4 / 25 * 35000)


def test_impact_without_staffing_or_staff(patients):
    bare = C.capacity_impact(patients({}, drop=["nurses_fte"]))
    assert "current_doctors" not in bare.columns
    none = C.capacity_impact(patients({"doctors_fte": 0.0, "nurses_fte": 0.0})).first()
    assert (none.patients_per_doctor, none.patients_per_nurse) == (50.0, 25.0)


def test_impact_of_an_empty_table(patients):
    row = C.capacity_impact(patients({}).where("false")).first()
    assert (row.total_patients, row.baseline_weeks, row.avg_weeks_saved) == (0, 0, 0.0)
    assert C.weekly_backlog(patients({}).where("false")).count() == 0
    assert C.backlog_timeline(patients({}).where("false")).count() == 5


def test_weekly_backlog(patients):
    df = patients(*[{}] * 5)
    rows = [r[:] for r in C.weekly_backlog(df, [Scenario(1, 2, 50)]).collect()]
    assert rows == [(1, 1, 3, 2), (1, 2, 1, 0), (1, 3, 0, 0)]


def test_horizons(spark):
    many = spark.range(6000).withColumnRenamed("id", "patient_id")
    assert C.weekly_backlog(many, [Scenario(1, 100, 0)]).count() == 60
    assert C.backlog_timeline(many, [Scenario(1, 100, 0)]).count() == 65
    assert C.backlog_timeline(many, [Scenario(1, 100, 0)], max_weeks=52).count() == 52
    weeks = [r.week for r in C.weekly_backlog(many, [Scenario(1, 2, 0)]).collect()]
    assert sorted(weeks) == list(range(1, 3001))
    assert C.backlog_timeline(many, [Scenario(1, 1000, 0)]).count() == 11
    backlog = [r.new_backlog for r in C.weekly_backlog(many).orderBy("week").collect()]
    assert backlog == sorted(backlog, reverse=True)


def test_question_style_answer(patients):
    row = C.capacity_answer(patients(*[{}] * 250), [Scenario(1, 100, 20)]).first()
    assert (row.baseline_weeks, row.new_weeks, row.weeks_saved) == (3, 3, 0)
    assert row.patients_moved_earlier == 40
    assert (row.additional_doctors_needed, row.additional_nurses_needed) == (0.8, 1.7)
    assert (row.mixed_doctors, row.mixed_nurses) == (0.7, 2.1)
    assert row.cost_doctors_only == 64000.0 and row.cost_nurses_only == 58333.0
    assert row.efficiency_gain == 0.0


def options(df):
    return {r.approach: (r.doctors_added, r.nurses_added, r.annual_cost) for r in df.collect()}


def test_staffing_options(patients):
    df = patients(*[{}] * 10)
    assert options(C.staffing_options(df)) == {
        "Doctors Only": (1, 0, 80000),
        "Nurses Only": (0, 3, 105000),
        "Mixed Team (Recommended)": (1, 2, 150000),
    }
    assert options(C.staffing_options_v1(df)) == {
        "Doctors Only": (1, 0, 80000),
        "Nurses Only": (0, 2, 70000),
        "Mixed Approach (Recommended)": (1, 3, 185000),
    }
    later = C.staffing_options(df).first()
    assert (later.current_doctors_needed, later.current_nurses_needed) == (4, 9)
    assert (later.total_doctors_needed, later.total_nurses_needed) == (5, 11)
    assert (later.actual_doctors, later.actual_nurses) == (10, 20)
    earlier = C.staffing_options_v1(df).first()
    # one patient per doctor and half a patient per nurse in the data
    assert (earlier.current_doctors_needed, earlier.current_nurses_needed) == (100, 200)


def test_nurses_for_72_places(patients):
    # 12 * 1.2 is just below 14.4
    row = C.staffing_options(patients({}), [Scenario(1, 72, 100)])
    assert options(row)["Mixed Team (Recommended)"][1] == 6


def test_staffing_options_without_staff_columns(patients):
    df = patients({}, drop=["doctors_fte", "nurses_fte"])
    assert C.staffing_options(df).first().actual_doctors == 4
    assert C.staffing_options_v1(df).first().current_doctors_needed == 4


def test_roi(patients):
    row = C.capacity_roi(patients({"cost_estimate": 1000.0})).first()
    assert (row.monthly_revenue, row.annual_revenue) == (80000.0, 1040000.0)
    assert row.annual_staff_cost == 150000
    assert row.payback_months == pytest.approx(150000 / (80000 - 12500))
    assert C.capacity_roi(patients({"cost_estimate": 1.0})).first().payback_months is None
    assert C.capacity_roi(patients({}), earlier_rules=True).first().annual_staff_cost == 185000


@pytest.mark.parametrize("bad", [Scenario(1, 0, 20), Scenario(1, 100, -5)])
def test_impossible_scenarios(patients, bad):
    with pytest.raises(ValueError):
        C.capacity_impact(patients({}), [bad])
