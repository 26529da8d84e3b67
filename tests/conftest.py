import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("carequeue-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(warehouse))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def patients(spark):
    """Build patients from keyword rows over plain defaults."""
    from carequeue.schema import PATIENT_SCHEMA

    plain = {
        "patient_id": 1,
        "age": 50,
        "specialty": "Dermatology",
        "gender": "F",
        "season": "Summer",
        "los": 1.0,
        "cost_estimate": 1000.0,
        "cancel_risk": 0.0,
        "planned_count": 100,
        "doctors_fte": 10.0,
        "nurses_fte": 20.0,
        "total_fte": 30.0,
    }

    def build(*rows, drop=()):
        full = [{**plain, "patient_id": i + 1, **row} for i, row in enumerate(rows)]
        values = [tuple(r[f.name] for f in PATIENT_SCHEMA.fields) for r in full]
        return spark.createDataFrame(values, PATIENT_SCHEMA).drop(*drop)

    return build
