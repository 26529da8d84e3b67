"""Every registered query against its SQL, and the plans they run with."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from carequeue.plans.oracle import ORACLE
from carequeue.plans.registry import QUERIES as REGISTERED

FOLDER = "/root/testdata/sf0.001"
TABLES = ["orders", "customer", "lineitem", "conversations", "documents", "benchmark"]
DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}
# fitted by iteration, so there is no SQL for them
WITHOUT_SQL = {"efficiency_model", "efficiency_model_lr", "efficiency_metrics", "feature_importance"}

# an automaton reads whole texts in Arrow batches
WITH_PYTHON = {"term_lookup_conversations", "term_lookup_documents"}

QUERIES, SQL = REGISTERED, ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(SQL[name])
    types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert found == expected
    assert found


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_fitted_models_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.count() == 18 and "avg_wait_days" in df.columns


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL - WITH_PYTHON - {"onehot_features"}))
def test_no_python_and_no_cartesian_product(spark, name):
    plan = physical(QUERIES[name](spark, FOLDER))
    for word in ["Python", "ArrowEval", "CartesianProduct", "MapInPandas"]:
        assert word not in plan


@pytest.mark.parametrize("name", ["specialty_counts", "season_counts_dense", "classify_questions"])
def test_unused_line_items_are_not_read(spark, name):
    assert "lineitem.parquet" not in physical(QUERIES[name](spark, FOLDER))


def test_scans_read_only_what_is_used(spark):
    plan = physical(QUERIES["specialty_analysis"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in plan
    assert "o_orderstatus" not in plan and "c_acctbal" not in plan
