"""The whole run over one waiting list: clean, score, classify, store, list high risks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame

from carequeue.functions.scoring import score_patients
from carequeue.operators import model as M
from carequeue.operators.normalize import labels_from_one_hot, normalize_patients
from carequeue.operators.reports import HIGH_RISK, high_risk_patients
from carequeue.schema import ONE_HOT_PREFIXES, one_hot_columns
from carequeue.sources.files import save_table


class BacklogRun(NamedTuple):
    patients: DataFrame
    high_risk: DataFrame
    model: PipelineModel


def run_backlog(
    raw: DataFrame,
    *id_order: Column | str,
    table: str | None = None,
    fmt: str = "parquet",
    model: str = "forest",
    risk_threshold: float = HIGH_RISK,
) -> BacklogRun:
    """Scored patients with the classifier's columns, and those at high risk.

    With ``table`` the patients are stored there and everything after reads that table.
    """
    if any(one_hot_columns(raw.columns, prefix) for prefix in ONE_HOT_PREFIXES):
        raw = labels_from_one_hot(raw)
    rows = M.stored_rows(score_patients(normalize_patients(raw, *id_order)))
    fitted = M.train(rows, model)
    patients = M.score(rows, fitted)
    if table:
        save_table(patients, table, fmt)
        patients = patients.sparkSession.table(table)
    return BacklogRun(patients, high_risk_patients(patients, risk_threshold), fitted)
