from pathlib import Path

from carequeue.operators.shared import intermediate_tables, shared_folder, written


def test_scope_deletes_its_tables(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    with intermediate_tables(spark):
        assert written(spark.range(5).toDF("id"), "scope").count() == 5
        assert set(folder.glob("*")) != before
    assert {p for p in folder.glob("*") if not p.name.startswith(".")} <= before


def test_given_folder_comes_first(spark, tmp_path):
    kept = written(spark.range(3).toDF("id"), "kept", str(tmp_path))
    assert kept.count() == 3
    assert list(tmp_path.glob("kept-*"))
