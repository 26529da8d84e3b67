import pytest

from carequeue.functions.scoring import score_patients
from carequeue.operators import reports as R
from carequeue.operators.normalize import normalize_patients


@pytest.fixture
def scored(patients):
    return lambda *rows, **kw: score_patients(normalize_patients(patients(*rows, **kw)))


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_reports_leave_missing_keys_out(scored):
    df = scored({"specialty": None}, {"specialty": "ENT"}, {"specialty": "ENT", "cost_estimate": None})
    report = rows(R.cost_impact(df))
    assert report == [
        {"specialty": "ENT", "total_cost": 1000.0, "avg_cost": 1000.0, "patient_count": 1,
         "potential_loss_from_cancellations": 0.0}
    ]
    assert [r["patient_count"] for r in rows(R.average_wait_time(df))] == [2]
    assert rows(R.specialty_counts(df)) == [{"specialty": "ENT", "patient_count": 2}]


def test_sum_of_nothing_is_zero(scored):
    df = scored({"specialty": "ENT", "cost_estimate": None})
    assert rows(R.cost_impact(df))[0]["total_cost"] == 0.0
    assert rows(R.overview_kpis(df))[0]["total_cost"] == 0.0


def test_high_risk_is_strict(scored):
    all_factors = {"age": 80, "los": 9.0, "cost_estimate": 9000.0}
    df = scored({**all_factors, "cancel_risk": 0.5}, {**all_factors, "cancel_risk": 0.6}, {})
    risk = df.orderBy("patient_id").collect()[0].readmit_risk
    assert [r["patient_id"] for r in rows(R.high_risk_patients(df, risk))] == [2]
    assert [r["patient_id"] for r in rows(R.high_risk_patients(df, 0.5))] == [2, 1]
    assert rows(R.high_risk_by_specialty(df, 50))[0]["high_risk_count"] == 2
    assert rows(R.high_risk_by_specialty(df, 50, ["ENT"])) == []


def test_high_risk_summary_without_patients(scored):
    assert rows(R.high_risk_summary(scored({}))) == [
        {"high_risk_patient_count": 0, "risk_threshold": 0.7, "avg_cost_high_risk": 0.0,
         "potential_intervention_needed": False}
    ]


@pytest.mark.parametrize(
    "ages, kept",
    [
        ({"age": 18}, [18]),
        ({"age": 18, "age_min": 0, "age_max": 120}, [18]),
        ({"age_min": 18, "age_max": 40}, [18, 36, 40]),
        ({"age_min": 60, "age_max": 120, "age_group": "child"}, [60, 61, 121][:2]),
        ({"age_group": "child"}, [0, 17]),
        ({"age_group": "young"}, [18]),
        ({"age_group": "young adult"}, [18]),
        ({"age_group": "adult"}, [36, 40, 60]),
        ({"age_group": "middle-aged"}, [40, 60]),
        ({"age_group": "elderly"}, [61, 121]),
        ({"age_group": "senior"}, [61, 121]),
        ({"age_min": 10}, [0, 17, 18, 36, 40, 60, 61, 121]),
        ({}, [0, 17, 18, 36, 40, 60, 61, 121]),
    ],
)
def test_age_filter_precedence(patients, ages, kept):
    df = patients(*[{"age": a} for a in [0, 17, 18, 36, 40, 60, 61, 121]])
    assert [r.age for r in R.filter_ages(df, **ages).orderBy("age").collect()] == kept


def test_age_filter_with_specialties(patients):
    df = patients({"specialty": "ENT"}, {"specialty": "Urology"}, {"specialty": None})
    kept = R.filter_ages(df, specialties=["ENT"]).collect()
    assert [r.specialty for r in kept] == ["ENT"]
    assert R.filter_ages(df, specialties=[]).count() == 3


def test_age_reports_order(scored):
    df = scored(
        {"age": 80, "cancel_risk": 0.1}, {"age": 5, "cancel_risk": 0.2}, {"age": 0},
        {"age": 30, "cancel_risk": 0.3, "cost_estimate": None},
    )
    assert [r["age_group"] for r in rows(R.age_based_risk(df))] == [
        "Child", "Young Adult", "Elderly",
    ]
    assert [r["age_group"] for r in rows(R.age_based_cancellation(df))] == [
        "Young Adult", "Child", "Elderly",
    ]
    assert {r["age_group"] for r in rows(R.age_based_cost(df))} == {"Child", "Elderly"}


def test_seasons_are_dense(scored):
    df = scored({"season": "Winter"}, {"season": None})
    assert [(r["season"], r["patient_count"]) for r in rows(R.season_counts(df))] == [
        ("Autumn", 0), ("Spring", 0), ("Summer", 0), ("Winter", 1),
    ]
    assert [r["avg_cancel_risk"] for r in rows(R.season_risk(df))] == [0.0] * 4


def test_seasonal_analysis_sorts_by_cancel_risk(scored):
    df = scored(
        {"season": "Winter", "cancel_risk": 0.1}, {"season": "Spring", "cancel_risk": 0.3},
        {"season": "Summer", "cancel_risk": 0.2},
    )
    assert [r["season"] for r in rows(R.seasonal_analysis(df))] == ["Spring", "Summer", "Winter"]
    assert [r["season"] for r in rows(R.seasonal_analysis(df, ["Winter"]))] == ["Winter"]
    assert [r["season"] for r in rows(R.seasonal_analysis_basic(df))][0] == "Spring"


def test_season_cost_delta(scored):
    df = scored(
        {"season": "Winter", "cost_estimate": 3_000_000.0},
        {"season": "Autumn", "cost_estimate": 1_500_000.0},
    )
    assert rows(R.season_cost_delta(df, "Winter")) == [
        {"current_season": "Winter", "previous_season": "Autumn", "current_cost": 3_000_000.0,
         "previous_cost": 1_500_000.0, "cost_delta": 1_500_000.0, "is_fallback": False,
         "delta_text": "+£1.5M from Autumn"}
    ]
    spring = rows(R.season_cost_delta(df, "Spring"))[0]
    assert spring["is_fallback"] and spring["delta_text"] == f"+£{0.45:.1f}M this quarter"
    assert spring["cost_delta"] == 450_000.0
    assert len(rows(R.season_cost_delta(df))) == 4


def test_season_cost_delta_negative_and_without_season(scored):
    df = scored(
        {"season": "Winter", "cost_estimate": 1_000_000.0},
        {"season": "Autumn", "cost_estimate": 2_500_000.0},
    )
    assert rows(R.season_cost_delta(df, "Winter"))[0]["delta_text"] == "£-1.5M from Autumn"
    bare = rows(R.season_cost_delta(df.drop("season"), "Winter"))[0]
    assert bare["is_fallback"] and bare["cost_delta"] == 350_000.0


def test_kpis(scored):
    df = scored({"season": "Winter", "age": 40}, {"age": None})
    kpis = rows(R.overview_kpis(df))[0]
    assert (kpis["total_patients"], kpis["winter_patients"], kpis["avg_age"]) == (2, 1, 40.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.049,), (0.05,), (0.71,), (1.0,), (None,)], "readmit_risk double")
    assert [(r["bin"], r["patient_count"], r["above_threshold"]) for r in rows(R.risk_histogram(df))] == [
        (0, 2, 0), (1, 1, 0), (14, 1, 1), (19, 1, 1),
    ]


def test_ties_go_to_the_first_name(scored):
    df = scored({"specialty": "Urology"}, {"specialty": "ENT"})
    assert rows(R.top_specialty(df)) == [{"specialty": "ENT", "patient_count": 1}]
    assert rows(R.highest_risk_specialty(df))[0]["specialty"] == "ENT"


def test_column_profile(patients):
    df = patients({"specialty": "ENT", "gender": None}, {"specialty": None, "gender": None})
    found = {r["column"]: r for r in rows(R.column_profile(df))}
    assert (found["specialty"]["distinct_values"], found["specialty"]["non_null"]) == (1, 1)
    assert found["gender"] == {"column": "gender", "distinct_values": 0, "non_null": 0, "all_null": True}


def test_cancellation_whatif(patients):
    df = patients({"cancel_risk": 0.5, "los": 2.0}, {"cancel_risk": 0.25, "los": 5.0})
    assert rows(R.cancellation_whatif(df, [20])) == [
        {"reduction_percentage": 20.0, "current_expected_cancellations": 0.75,
         "cancellations_prevented": 0.15, "cost_savings": 150.0, "bed_days_freed": 0.53,
         "weekly_capacity_freed": 0.38}
    ]
    by = R.cancellation_whatif(df, [20, 40], ["specialty"])
    assert by.count() == 2 and by.columns[0] == "specialty"


def test_unknown_specialty_keeps_its_name(patients):
    df = patients({"specialty": "Trauma & Orthopaedics"}, {"specialty": "Podiatry"})
    joined = R.join_specialty_dimension(df).orderBy("patient_id").collect()
    assert [(r.name, r.weight) for r in joined] == [("Orthopedics", 0.05), ("Podiatry", 0.0)]


def test_performance_is_rounded(scored):
    df = scored({"cancel_risk": 0.005}, {"cancel_risk": 0.005})
    assert rows(R.specialty_performance(df))[0]["avg_cancel_risk"] == 0.0


@pytest.mark.parametrize(
    "report",
    [R.average_wait_time, R.specialty_analysis, R.high_risk_by_specialty, R.cost_impact,
     R.seasonal_analysis, R.age_based_risk, R.age_based_cancellation, R.age_based_cost,
     R.risk_histogram, R.wait_ranking, R.top_specialty],
)
def test_reports_of_an_empty_table(scored, report):
    assert report(scored({}).where("false")).count() == 0
