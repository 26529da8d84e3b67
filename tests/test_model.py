import random

import duckdb
import pytest
from pyspark.sql import functions as F

from carequeue.functions.scoring import score_patients
from carequeue.operators import model as M
from carequeue.operators.normalize import normalize_patients
from carequeue.sources.grid import reference_grid


@pytest.fixture(scope="module")
def people(spark):
    grid = reference_grid(spark).withColumns(
        {
            "planned_count": F.expr("cast(50 + patient_id * 37 % 900 as int)"),
            "cancel_risk": F.expr("if(patient_id % 41 = 0, null, patient_id * 13 % 100 / 1000D)"),
            "gender": F.expr("if(patient_id % 50 = 0, null, gender)"),
        }
    )
    return score_patients(normalize_patients(grid)).cache()


def test_forest_beats_the_majority(people):
    scored = M.efficiency_model(people)
    assert scored.count() == people.count()
    right = scored.agg(F.avg(F.expr("if(prediction = efficiency_label, 1, 0)"))).first()[0]
    rate = scored.agg(F.avg("efficiency_label")).first()[0]
    assert right > max(rate, 1 - rate)
    assert scored.where("score < 0 or score > 1 or percentage <> bround(score * 100, 2)").count() == 0
    assert set(people.columns) <= set(scored.columns)
    assert scored.where("gender is null").count() == people.where("gender is null").count()
    assert not [c for c in scored.columns if c.startswith("feature")]


def test_logistic_model(people):
    scored = M.efficiency_model(people, "logistic", numeric_only=True)
    assert scored.where("prediction not in (0, 1)").count() == 0


def test_unknown_model(people):
    with pytest.raises(ValueError):
        M.train(M.training_rows(people), "boosted")


def test_metrics_are_repeatable(people):
    first, second = (
        {r["sample"]: (round(r.auc, 3), round(r.accuracy, 3)) for r in M.evaluate(people).collect()}
        for _ in range(2)
    )
    assert first == second and set(first) == {"training rows", "held out"}
    assert first["training rows"][0] > 0.9


def test_importance_names_the_features(people):
    rows = M.training_rows(people)
    found = M.feature_importance(rows, M.train(rows), top=100).collect()
    names = [r.feature for r in found]
    assert {"age", "cancel_risk", "patients_per_doctor", "specialty_ENT"} <= set(names)
    values = [r.importance for r in found]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1.0)
    numeric = M.feature_importance(rows, M.train(rows, numeric_only=True))
    assert numeric.count() == 5
    assert {r.feature for r in numeric.collect()} <= {*M.NUMERIC, *M.STAFFING}


def test_one_hot_drops_the_first_value(people):
    features = M.onehot_features(people)
    assert "specialty_Cardiology" not in features.columns and "gender_F" not in features.columns
    assert {"specialty_ENT", "specialty_Urology", "gender_M", "season_Winter"} <= set(features.columns)
    joined = features.join(people.select("patient_id", "specialty", "gender", "season"), "patient_id")
    wrong = joined.where(
        "specialty_ENT <> int(specialty = 'ENT') or season_Winter <> int(season = 'Winter')"
        " or gender_M <> int(coalesce(gender = 'M', false))"
    )
    assert wrong.count() == 0


def test_model_without_staffing(people):
    bare = people.drop("doctors_fte", "nurses_fte", "total_fte")
    assert M.efficiency_model(bare, numeric_only=True).count() == people.count()


@pytest.mark.parametrize("model", ["forest", "logistic"])
def test_scores_of_every_patient(people, model):
    """A row for each patient, chances between 0 and 1, and rows held out are told apart."""
    scored = M.efficiency_model(people, model)
    ids = scored.select("patient_id").collect()
    assert sorted(r[0] for r in ids) == sorted(r[0] for r in people.select("patient_id").collect())
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert scored.where("prediction <> if(score > 0.5, 1, 0) and score <> 0.5").count() == 0
    rows = M.stored_rows(people)
    held = M.spread("patient_id", 5) == 0
    unseen = M.score(rows.where(held), M.train(rows.where(~held), model))
    right = unseen.agg(F.avg(F.expr("int(prediction = efficiency_label)"))).first()[0]
    rate = unseen.agg(F.avg("efficiency_label")).first()[0]
    assert right > max(rate, 1 - rate)


def test_learning_reads_even_parts(spark, people):
    """As many parts as cores, none twice as large as the mean, and the same in each run."""
    for df in (people, people.coalesce(1)):
        rows = M.stored_rows(df)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sum(sizes) == people.count() and max(sizes) < 2 * people.count() / len(sizes)
    found = [M.feature_importance(rows, M.train(rows), top=100).collect() for _ in range(2)]
    assert found[0] == found[1]


AUC = """with s as (select score, efficiency_label as y from scored)
select (sum(case when a.score > b.score then 2 when a.score = b.score then 1 else 0 end))
  / (2.0::double * count(*)) from s a, s b where a.y = 1 and b.y = 0"""


def plain_area(rows):
    scored = rows.select("score", "efficiency_label").toPandas()  # noqa: F841
    return duckdb.sql(AUC).fetchall()[0][0]


def test_area_under_the_curve_is_exact(spark, people):
    rows = M.efficiency_model(people)
    assert M.area_under_curve(rows) == pytest.approx(plain_area(rows), abs=1e-12)
    rng = random.Random(2)
    ties = [(rng.randrange(12) / 11, rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(ties, "score double, efficiency_label int")
    assert M.area_under_curve(df) == pytest.approx(plain_area(df), abs=1e-12)
    assert M.area_under_curve(df.where("efficiency_label = 1")) is None
    assert M.area_under_curve(df.limit(0)) is None


def test_metrics_agree_with_the_stored_scores(people):
    rows = M.stored_rows(people)
    scores = M.score(rows, M.train(rows))
    found = {r["sample"]: r for r in M.evaluate(people).collect()}["training rows"]
    assert found.auc == pytest.approx(plain_area(scores), abs=1e-12)
    right = scores.agg(F.avg(F.expr("int(prediction = efficiency_label)"))).first()[0]
    assert found.accuracy == pytest.approx(right, abs=1e-12)
