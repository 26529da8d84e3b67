from pyspark.sql import functions as F

from carequeue.operators import questions as Q
from carequeue.operators import reports as R
from carequeue.operators.shared import shared_folder
from carequeue.plans.backlog_run import run_backlog
from carequeue.plans.registry import patients, scored
from carequeue.schema import validate_patients
from carequeue.sources.files import save_parquet

FOLDER = "/root/testdata/sf0.001"


def test_run_stores_scored_patients(spark):
    raw = patients(spark, FOLDER)
    run = run_backlog(raw, table="whole_run_test")
    assert validate_patients(run.patients) == (True, "All required columns are present")
    assert run.patients.count() == raw.count() == spark.table("whole_run_test").count()
    assert {"prediction", "score", "percentage", "efficiency_label"} <= set(run.patients.columns)
    assert run.high_risk.count() == run.patients.where("readmit_risk > 0.7").count() > 0
    spark.sql("drop table whole_run_test")


def test_run_from_one_hot_columns(spark):
    raw = patients(spark, FOLDER)
    names = ["ENT", "Urology", "Cardiology"]
    flags = [F.expr(f"int(specialty = '{n}')").alias(f"specialty_{n}") for n in names]
    encoded = raw.select("*", *flags).drop("specialty")
    found = run_backlog(encoded, model="logistic").patients
    assert {r[0] for r in found.select("specialty").distinct().collect()} == {
        *names, "General Surgery",
    }


def test_one_question(spark):
    people = scored(spark, FOLDER)
    rows = Q.ask("Impact of Baseline capacity 200 and Capacity Increase by 20%", people).collect()
    values = {r.metric: r.value for r in rows}
    assert (values["new_capacity"], values["baseline_weeks"]) == (240.0, 8.0)


def test_a_question_reads_only_what_its_report_needs(spark, monkeypatch):
    kept = []
    write = Q.written
    monkeypatch.setattr(Q, "written", lambda df, name: kept.append(name) or write(df, name))
    people = patients(spark, FOLDER).selectExpr(
        "*", "0D as priority_score", "0.8D as readmit_risk", "1 as wait_days"
    )
    assert Q.ask("hello", people).count() == 10 * len(Q.PREVIEW_METRICS)
    assert "cells" not in kept and "risks" not in kept
    assert Q.ask("high risk case", people).count() == 18 * 3
    assert "cells" not in kept and "risks" in kept


def test_no_questions(spark):
    none = spark.createDataFrame([], "question_id long, question string")
    people = patients(spark, FOLDER)
    assert Q.answer_questions(none, people).count() == 0
    assert Q.format_answers(none, people).count() == 0


def test_questions_share_one_hot_request(spark):
    """A third of all questions ask the same; every one is answered."""
    people = patients(spark, FOLDER).selectExpr(
        "*", "0D as priority_score", "0.8D as readmit_risk", "1 as wait_days"
    )
    asked = spark.range(9000).selectExpr(
        "id as question_id",
        "if(id % 3 = 0, 'average wait time', concat('high risk case ', id % 50, '%')) as question",
    )
    found = Q.answer_questions(asked, people).groupBy("report").count().collect()
    counts = {r.report: r["count"] for r in found}
    assert counts == {"average_wait_time": 3000 * 18 * 2, "high_risk_patients": 6000 * 18 * 3}


def test_shared_folder_rules(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key.removeprefix("spark.").replace(".", "_"), default)

    class Session:
        def __init__(self, checkpoint=None, **values):
            self.conf = Conf(**values)
            self.sparkContext = self
            self.getCheckpointDir = lambda: checkpoint

    stored = {"sql_warehouse_dir": "hdfs:/w/"}
    assert shared_folder(Session(checkpoint_dir="hdfs:/x", **stored)) == "hdfs:/x"
    assert shared_folder(Session(checkpoint="hdfs:/y", **stored)) == "hdfs:/y"
    assert shared_folder(Session(**stored)) == "hdfs:/w/_intermediate"
    assert shared_folder(Session(checkpoint_dir="hdfs:/x"), "hdfs:/given") == "hdfs:/given"


def test_sort_merge_path_gives_the_same_answers(spark, tmp_path):
    """Beyond the broadcast threshold every join shuffles; results stay."""
    people = patients(spark, FOLDER).selectExpr(
        "*", "0D as priority_score", "cancel_risk * 8 as readmit_risk", "1 as wait_days"
    )
    save_parquet(people, str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    texts = ["high risk case 33.3%", "risky case 41%", "winter effect in ENT", "risk by segment"]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")

    def answers():
        return sorted(
            (r.question_id, r.key, r.metric, round(r.value, 9))
            for r in Q.answer_questions(asked, people).collect()
        )

    usual = answers()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert answers() == usual
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    report = R.high_risk_by_specialty(people, 41).collect()
    assert {r.specialty for r in report} == {k for i, k, _, _ in usual if i == 1}
