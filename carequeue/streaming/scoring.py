"""Scores on a stream of patient files: the same stateless expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carequeue.functions.scoring import score_patients
from carequeue.operators.normalize import normalize_patients
from carequeue.schema import PATIENT_SCHEMA


def score_stream(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """Streaming frame of scored patients from files of the layout with ids and ages."""
    arriving = spark.readStream.schema(PATIENT_SCHEMA).format(fmt).load(folder)
    return score_patients(normalize_patients(arriving))
