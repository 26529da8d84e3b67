import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from carequeue.functions.scoring import score_patients
from carequeue.operators.normalize import normalize_patients
from carequeue.plans.backlog_run import run_backlog
from carequeue.sources.files import (
    clashing_values,
    read_patients,
    run_sql,
    save_parquet,
    save_table,
)
from carequeue.sources.grid import reference_grid
from carequeue.streaming.scoring import score_stream


def test_csv_types_come_from_the_header(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("patient_id,age,specialty,los,specialty_ENT,note\n1,30,ENT,2.5,1,a\n2,x,,oops,0,b\n")
    df = read_patients(spark, str(path))
    assert dict(df.dtypes) == {
        "patient_id": "bigint", "age": "int", "specialty": "string", "los": "double",
        "specialty_ENT": "int", "note": "string",
    }
    rows = df.orderBy("patient_id").collect()
    assert rows[0][:] == (1, 30, "ENT", 2.5, 1, "a")
    assert rows[1].age is None and rows[1].los is None


def test_csv_with_age_bands_end_to_end(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text("age_band,specialty,gender,los\n18-34,ENT,F,2\n85+,Urology,M,9\n")
    df = score_patients(normalize_patients(read_patients(spark, str(path)), "los"))
    rows = df.orderBy("patient_id").collect()
    assert rows[0].priority_score == pytest.approx(0.03, abs=0.07)
    assert rows[1].age >= 85 and rows[1].priority_score >= 0.15 + 0.15 + 0.11


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_patients(spark, str(tmp_path / "none.csv"))


def test_table_sink_replaces_schema(spark, patients):
    save_table(patients({}, {}), "sink_test")
    save_table(patients({}).select("patient_id"), "sink_test")
    assert spark.table("sink_test").columns == ["patient_id"]
    assert spark.table("sink_test").count() == 1
    spark.sql("drop table sink_test")


def test_parquet_sink(spark, patients, tmp_path):
    path = str(tmp_path / "out")
    save_parquet(patients({}, {}), path)
    save_parquet(patients({}, {}, {}), path)
    assert read_patients(spark, path, "parquet").count() == 3


def test_sql_over_patients(patients):
    assert run_sql(patients({}, {"age": 20}), "select max(age) m from patients").first().m == 50
    with pytest.raises(AnalysisException):
        run_sql(patients({}), "select nothing from patients")


def test_a_folder_with_three_layouts(spark, tmp_path):
    (tmp_path / "in" / "old").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text("patient_id,age,specialty,los\n1,30,ENT,2.5\n2,40,Urology,1\n")
    (tmp_path / "in/b.csv").write_text("los,specialty,patient_id,age\n7,ENT,3,50\n")  # another order
    (tmp_path / "in/old/c.csv").write_text("age_band,specialty,note\n18-34,ENT,x\n")
    (tmp_path / "in/d.csv").write_text("patient_id,specialty_ENT,los\n9,1,4\n")
    (tmp_path / "in/empty.csv").write_text("")
    (tmp_path / "in/_SUCCESS").write_text("")
    df = read_patients(spark, str(tmp_path / "in"))
    assert dict(df.dtypes) == {
        "patient_id": "bigint", "age": "int", "specialty": "string", "los": "double",
        "age_band": "string", "note": "string", "specialty_ENT": "int",
    }
    rows = {(r.patient_id, r.age, r.specialty, r.los, r.age_band, r.note, r.specialty_ENT) for r in df.collect()}
    assert rows == {
        (1, 30, "ENT", 2.5, None, None, None), (2, 40, "Urology", 1.0, None, None, None),
        (3, 50, "ENT", 7.0, None, None, None), (None, None, "ENT", None, "18-34", "x", None),
        (9, None, None, 4.0, None, None, 1),
    }
    assert read_patients(spark, str(tmp_path / "in" / "*.csv")).count() == 4
    with pytest.raises(AnalysisException):
        read_patients(spark, str(tmp_path / "in" / "none"))


def test_clashing_values_are_told_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patient_id,age,los\n1,30,2.5\n2,old,1\n3,x,\n")
    (tmp_path / "b.csv").write_text("los,note\nlong,1\n 2 ,b\n")
    (tmp_path / "c.csv").write_text("specialty\nENT\n")
    found = [(r.file.rsplit("/", 1)[1], *r[1:]) for r in clashing_values(spark, str(tmp_path)).collect()]
    assert sorted(found) == [("a.csv", "age", "int", 2, "old"), ("b.csv", "los", "double", 1, "long")]
    assert clashing_values(spark, str(tmp_path / "c.csv")).count() == 0


def test_parquet_files_of_unlike_schemas(spark, patients, tmp_path):
    folder = str(tmp_path)
    patients({}).drop("gender").coalesce(1).write.parquet(f"{folder}/one")
    patients({"patient_id": 7}).withColumn("more", F.lit("x")).coalesce(1).write.parquet(f"{folder}/two")
    rows = read_patients(spark, folder, "parquet").orderBy("patient_id").collect()
    assert [(r.patient_id, r.gender, r.more) for r in rows] == [(1, None, None), (7, "F", "x")]
    patients({}).withColumn("age", F.lit("old")).coalesce(1).write.parquet(f"{folder}/zero")
    with pytest.raises(ValueError, match="column age is .* in .*/(one|two|zero)/part-"):
        read_patients(spark, folder, "parquet")


def test_a_table_is_replaced_by_rows_read_from_it(spark, patients):
    save_table(patients({}, {}, {}), "swapped")
    save_table(spark.table("swapped").where("patient_id > 1").select("patient_id"), "swapped")
    assert sorted(r[0] for r in spark.table("swapped").collect()) == [2, 3]
    # a run that fails leaves the table as it was
    bad = spark.table("swapped").selectExpr("raise_error('broken') as patient_id")
    with pytest.raises(Exception, match="broken"):
        save_table(bad, "swapped")
    assert sorted(r[0] for r in spark.table("swapped").collect()) == [2, 3]
    assert [t.name for t in spark.catalog.listTables() if "swapped_" in t.name] == []
    spark.sql("drop table swapped")


def test_a_run_over_its_own_table_gives_equal_rows(spark, patients):
    raw = patients(*[{"age": 20 + i, "specialty": "ENT" if i % 2 else "Urology",
                      "cancel_risk": i / 400, "planned_count": 50 + 40 * i} for i in range(60)])
    run_backlog(raw, table="own_table", model="logistic")
    first = spark.table("own_table").orderBy("patient_id").collect()
    kept = [f.name for f in raw.schema.fields]
    run_backlog(spark.table("own_table").select(*kept), table="own_table", model="logistic")
    second = spark.table("own_table").orderBy("patient_id").collect()
    shown = ["patient_id", "priority_score", "readmit_risk", "wait_days", "prediction"]
    assert [[r[c] for c in shown] for r in second] == [[r[c] for c in shown] for r in first]
    spark.sql("drop table own_table")


def test_sql_over_a_frame_makes_no_view(spark, patients):
    one, two = (run_sql(patients(*[{}] * n), "select count(*) n from {patients}") for n in (1, 2))
    assert (one.first().n, two.first().n) == (1, 2)


def test_grid(spark):
    grid = reference_grid(spark).orderBy("patient_id").collect()
    assert len(grid) == 840 and [r.patient_id for r in grid] == list(range(1, 841))
    assert len({(r.specialty, r.season, r.gender, r.age) for r in grid}) == 840
    assert {r.age for r in grid} == set(range(18, 91, 5))
    first, last = grid[0], grid[-1]
    assert (first.specialty, first.season, first.gender, first.age) == ("Orthopedics", "Winter", "M", 18)
    assert (last.specialty, last.season, last.gender, last.age) == ("Cardiology", "Autumn", "F", 88)
    assert (last.los, last.cost_estimate, last.cancel_risk) == (5.1, 5200.0, 0.018)
    assert (grid[15].gender, grid[30].season, grid[120].specialty) == ("F", "Spring", "ENT")


def test_scores_on_a_stream(spark, patients, tmp_path):
    folder = str(tmp_path / "arriving")
    batch = patients({"age": 80}, {"season": "Winter"}, {"cancel_risk": float("nan")})
    save_parquet(batch, folder)
    query = (
        score_stream(spark, folder)
        .writeStream.format("memory")
        .queryName("scored_stream")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    columns = ["patient_id", "priority_score", "readmit_risk", "wait_days"]
    streamed = sorted(spark.table("scored_stream").select(columns).collect())
    assert streamed == sorted(
        score_patients(normalize_patients(batch)).select(columns).collect()
    )
