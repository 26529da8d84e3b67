"""Registered queries: each reads the tables of a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions import scoring as S
from carequeue.functions.calendar import season_of_date
from carequeue.operators import capacity as C
from carequeue.operators import lookup as L
from carequeue.operators import model as M
from carequeue.operators import normalize as N
from carequeue.operators import questions as Q
from carequeue.operators import queue_index as W
from carequeue.operators import reports as R
from carequeue.operators.sampling import fixed_sample, preview
from carequeue.plans import asked as A
from carequeue.sources.files import run_sql
from carequeue.sources.tables import RAW_SPECIALTIES, load_table, raw_patients

SCENARIOS = (
    C.Scenario(1, 100, 20),
    C.Scenario(2, 100, 15),
    C.Scenario(3, 200, 20),
    C.Scenario(4, 50, 0),
    C.Scenario(5, 500, 100),
)
REDUCTIONS = (5.0, 15.0, 20.0, 37.5)
BATCHES = 3
SCHEDULE = ["patient_id", "priority_score", "wait_days"]


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return N.normalize_patients(raw_patients(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return S.score_patients(patients(spark, folder))


def _exact(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: build(scored(spark, folder))


def _joined(column: str):
    return F.array_join(F.col(column), "|").alias(column)


def normalize_patients(spark: SparkSession, folder: str) -> DataFrame:
    return patients(spark, folder).select(
        "patient_id", "age", "age_min", "age_max", "specialty", "gender", "season", "los",
        "cost_estimate", "cancel_risk", "planned_count",
    )


def parse_age_band(spark: SparkSession, folder: str) -> DataFrame:
    """The patients in the layout with age bands, normalized."""
    age = F.col("age")
    bands = (
        raw_patients(spark, folder)
        .withColumn(
            "age_band",
            F.when(age < 18, "0-17").when(age < 35, "18-34").when(age < 65, "35-64")
            .when(age < 85, "65-84").otherwise("85+"),
        )
        .drop("age")
    )
    return N.normalize_patients(bands).select(
        "patient_id", "age_band", "age_min", "age_max", "age"
    )


def onehot_to_label(spark: SparkSession, folder: str) -> DataFrame:
    """The patients with one-hot columns in place of labels, and the labels rebuilt."""
    raw = raw_patients(spark, folder)
    flags = [
        F.when(F.col("specialty") == s, 1).otherwise(0).alias(f"specialty_{s}")
        for s in RAW_SPECIALTIES[1:]
    ]
    seasons = [
        F.when(F.col("season") == s, 1).otherwise(0).alias(f"season_{s}")
        for s in ["Spring", "Summer", "Winter"]
    ]
    gender = F.when(F.col("gender") == "M", 1).otherwise(0).alias("gender_M")
    encoded = raw.select("patient_id", *flags, *seasons, gender)
    return N.labels_from_one_hot(encoded).select("patient_id", "specialty", "gender", "season")


def sql_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(
        scored(spark, folder),
        """select specialty, gender, count(*) as patient_count,
                  avg(wait_days) as avg_wait_days
           from {patients} group by specialty, gender""",
    )


def season_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "orders").select(
        "o_orderkey", season_of_date("o_orderdate").alias("season")
    )


def specialty_dim_join(spark: SparkSession, folder: str) -> DataFrame:
    return (
        R.join_specialty_dimension(raw_patients(spark, folder))
        .groupBy("specialty", "name", "weight")
        .agg(F.count("*").alias("patient_count"))
    )


def extract_parameters(spark: SparkSession, folder: str) -> DataFrame:
    found = Q.extract_parameters(A.patient_questions(patients(spark, folder)))
    texts = [_joined("specialties"), _joined("seasons")]
    numbers = F.array_join(F.col("numbers").cast("array<string>"), "|").alias("numbers")
    return found.select(
        "question_id", "percentage", numbers, "baseline_capacity", "weekly_capacity",
        "risk_weight", "threshold", *texts, "age", "age_min", "age_max", "age_group",
    )


def _said(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of the conversations as a question, whole texts."""
    number = F.col("conv_id") * 100_000 + F.col("turn")
    return load_table(spark, folder, "conversations").select(
        number.alias("question_id"), F.col("text").alias("question")
    )


def _written_texts(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question")
    )


def route_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return Q.route_questions(_said(spark, folder)).select("question_id", "question_type", "report")


def route_documents(spark: SparkSession, folder: str) -> DataFrame:
    routed = Q.route_questions(_written_texts(spark, folder))
    return routed.select("question_id", "question_type", "report")


def _extracted(texts: DataFrame, shown: str = "cast(x as string)") -> DataFrame:
    numbers = F.array_join(F.expr(f"transform(numbers, x -> {shown})"), "|").alias("numbers")
    return Q.extract_parameters(texts).select(
        "question_id", "percentage", numbers, "baseline_capacity", "risk_weight", "threshold",
        _joined("specialties"), _joined("seasons"), "age", "age_min", "age_max", "age_group",
    )


def extract_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(_said(spark, folder))


def term_lookup_conversations(spark: SparkSession, folder: str) -> DataFrame:
    said = _said(spark, folder)
    return L.lookup_terms_in(said, L.glossary(spark), "question", "question_id").select(
        "question_id", "position", "term", "title", "url"
    )


def term_lookup_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents against a glossary of all words of the benchmark."""
    texts = _written_texts(spark, folder)
    terms = A.terms_and_words(spark, folder)
    return L.lookup_terms_in(texts, terms, "question", "question_id").select(
        "question_id", "position", "term", "title", "url"
    )


def suggest_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed suggestions for what is typed, beginnings and whole questions."""
    typed = A.whole_and_prefixes(patients(spark, folder))
    return L.suggest_from(typed, L.suggestions(spark))


def suggest_asked(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that others asked, for what is typed."""
    people = patients(spark, folder)
    return L.suggest_from(A.whole_and_prefixes(people), A.asked_before(people))


def extract_documents(spark: SparkSession, folder: str) -> DataFrame:
    # card numbers are long, and engines write large doubles in unlike ways
    shown = """concat(try_cast(floor(x) as bigint), '+', cast(x - floor(x) as decimal(9, 6)))"""
    return _extracted(_written_texts(spark, folder), shown)


def queue_after_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Positions after each of three batches of patients has joined a stored queue."""
    people = scored(spark, folder).select(*SCHEDULE)
    after = []
    queue = None
    for k in range(BATCHES):
        batch = people.where(F.col("patient_id") % BATCHES == k)
        queue = W.new_queue(batch) if queue is None else W.add_batch(queue, batch)
        after.append(W.positions(queue, spark).withColumn("batches", F.lit(k + 1)))
    return reduce(DataFrame.unionByName, after)


def _asking(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One question per patient, and the patients, evaluated once for both."""
    people = Q.stored_patients(scored(spark, folder))
    return A.patient_questions(people), people


def answer_questions(spark: SparkSession, folder: str) -> DataFrame:
    return Q.answer_questions(*_asking(spark, folder))


def answers_by_request(spark: SparkSession, folder: str) -> DataFrame:
    return Q.answers_by_request(*_asking(spark, folder))


def format_answers(spark: SparkSession, folder: str) -> DataFrame:
    return Q.format_answers(*_asking(spark, folder))


def _questions(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: build(A.patient_questions(patients(spark, folder)))


def _model(name: str):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return M.efficiency_model(scored(spark, folder), name).select(
            "patient_id", "efficiency_label", "prediction", "score", "percentage"
        )

    return build


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.stored_rows(scored(spark, folder))
    return M.feature_importance(rows, M.train(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # input and row-wise columns
    "normalize_patients": normalize_patients,
    "parse_age_band": parse_age_band,
    "onehot_to_label": onehot_to_label,
    "sql_passthrough": sql_passthrough,
    "season_of_date": season_of_orders,
    "priority_score": _exact(lambda p: p.select("patient_id", "priority_score")),
    "readmit_risk": _exact(lambda p: p.select("patient_id", "readmit_risk")),
    "staffing_ratios": _exact(
        lambda p: S.with_staffing_ratios(p).select("patient_id", *M.STAFFING)
    ),
    "efficiency_label": _exact(
        lambda p: S.with_efficiency_label(p).select("patient_id", "efficiency_label")
    ),
    "wait_days": _exact(lambda p: p.select("patient_id", "wait_days")),
    "age_group": _exact(
        lambda p: p.select("patient_id", "age", S.age_group().alias("age_group"))
    ),
    # filters
    "high_risk_patients_list": _exact(
        lambda p: R.high_risk_patients(
            p.select("patient_id", "specialty", "readmit_risk", "cost_estimate")
        )
    ),
    "avg_wait_filtered": _exact(
        lambda p: R.average_wait_time(p, ["Cardiology", "ENT", "Orthopedics"])
    ),
    "seasonal_filtered": _exact(
        lambda p: R.seasonal_analysis(p, ["Winter", "Summer"], ["Cardiology", "Urology"])
    ),
    "age_filter": _exact(
        lambda p: R.filter_ages(p, age_min=40, age_max=60, specialties=["ENT", "Urology"])
        .select("patient_id", "age", "specialty")
    ),
    # joins with dimensions, lookups
    "specialty_dim_join": specialty_dim_join,
    "season_counts_dense": _exact(R.season_counts),
    "season_risk": _exact(R.season_risk),
    "term_lookup": lambda spark, folder: L.lookup_terms(
        A.patient_searches(patients(spark, folder))
    ).select("patient_id", "search", "term", "title", "url"),
    "term_lookup_conversations": term_lookup_conversations,
    "term_lookup_documents": term_lookup_documents,
    "suggest_queries": suggest_queries,
    "suggest_asked": suggest_asked,
    # reports
    "average_wait_time": _exact(R.average_wait_time),
    "specialty_analysis": _exact(R.specialty_analysis),
    "high_risk_by_specialty": _exact(R.high_risk_by_specialty),
    "cost_impact": _exact(R.cost_impact),
    "seasonal_analysis_basic": _exact(R.seasonal_analysis_basic),
    "seasonal_analysis": _exact(R.seasonal_analysis),
    "age_based_risk": _exact(R.age_based_risk),
    "age_based_cancellation": _exact(R.age_based_cancellation),
    "age_based_cost": _exact(R.age_based_cost),
    "overview_kpis": _exact(R.overview_kpis),
    "season_cost_delta": _exact(R.season_cost_delta),
    "specialty_counts": _exact(R.specialty_counts),
    "wait_ranking": _exact(R.wait_ranking),
    "specialty_performance": _exact(R.specialty_performance),
    "risk_histogram": _exact(R.risk_histogram),
    "cancel_ranking": _exact(R.cancel_ranking),
    "top_specialty": _exact(R.top_specialty),
    "highest_risk_specialty": _exact(R.highest_risk_specialty),
    "column_profile": _exact(R.column_profile),
    "label_rate": _exact(lambda p: R.label_rate(S.with_efficiency_label(p))),
    "cancellation_whatif": _exact(lambda p: R.cancellation_whatif(p, REDUCTIONS)),
    "high_risk_summary": _exact(R.high_risk_summary),
    # ranks, schedules, samples
    "queue_position": _exact(lambda p: C.queue_positions(p.select(*SCHEDULE))),
    "queue_after_batches": queue_after_batches,
    "capacity_schedule": _exact(lambda p: C.capacity_schedule(p.select(*SCHEDULE))),
    "optimize_schedule": _exact(
        lambda p: C.optimize_schedule(p.select(*SCHEDULE, "readmit_risk"))
    ),
    "preview": _exact(
        lambda p: preview(p.select("patient_id", "specialty", *Q.PREVIEW_METRICS))
    ),
    "fixed_sample": _exact(
        lambda p: fixed_sample(p.select("patient_id", "specialty", "cost_estimate"), 5000)
    ),
    # capacity and staffing
    "capacity_impact": _exact(lambda p: C.capacity_impact(p, SCENARIOS)),
    "weekly_backlog": _exact(lambda p: C.weekly_backlog(p, SCENARIOS)),
    "capacity_answer": _exact(lambda p: C.capacity_answer(p, SCENARIOS, ["specialty"])),
    "staffing_options_v1": _exact(lambda p: C.staffing_options_v1(p, SCENARIOS)),
    "staffing_options": _exact(lambda p: C.staffing_options(p, SCENARIOS)),
    "backlog_timeline": _exact(lambda p: C.backlog_timeline(p, SCENARIOS, ["specialty"])),
    "capacity_roi": _exact(lambda p: C.capacity_roi(p, SCENARIOS)),
    # questions
    "classify_questions": _questions(Q.classify_questions),
    "extract_parameters": extract_parameters,
    "route_questions": _questions(Q.route_questions),
    "route_conversations": route_conversations,
    "extract_conversations": extract_conversations,
    "extract_documents": extract_documents,
    "route_documents": route_documents,
    "answer_questions": answer_questions,
    "answers_by_request": answers_by_request,
    "format_answers": format_answers,
    # classifier
    "onehot_features": lambda spark, folder: M.onehot_features(patients(spark, folder)),
    "efficiency_model": _model("forest"),
    "efficiency_model_lr": _model("logistic"),
    "efficiency_metrics": lambda spark, folder: M.evaluate(scored(spark, folder)),
    "feature_importance": feature_importance,
}
