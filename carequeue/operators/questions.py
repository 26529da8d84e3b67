"""Answer tables of plain-English questions from scored patients.

Many questions ask for the same thing. Each is reduced to a request, a report with the
parameters that report reads; the distinct requests are answered from aggregates of the
patients, and the answers are joined back to the questions. Patients are never paired
with questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carequeue.functions import exact
from carequeue.functions import fixed_values as V
from carequeue.functions.questions import (
    age_range,
    question_parameters,
    question_report,
    question_type,
)
from carequeue.functions.scoring import age_group
from carequeue.operators.capacity import capacity_answer_columns
from carequeue.operators.rank import running_sums
from carequeue.operators.sampling import preview
from carequeue.operators.shared import at_the_same_time, dealt_out_if_small, written

ALL = "*"  # stands for every specialty or season

SPECIALTY_REPORTS = ["average_wait_time", "specialty_analysis", "cost_impact"]
AGE_REPORTS = ["age_based_risk", "age_based_cancellation", "age_based_cost"]
PREVIEW_SIZE = 10
PREVIEW_METRICS = [
    "age",
    "los",
    "cost_estimate",
    "cancel_risk",
    "priority_score",
    "readmit_risk",
    "wait_days",
]


def _lowered(df: DataFrame) -> DataFrame:
    return df.withColumn("_lowered", F.lower("question"))


def classify_questions(df: DataFrame) -> DataFrame:
    return _lowered(df).withColumn("question_type", question_type("_lowered")).drop("_lowered")


def extract_parameters(df: DataFrame) -> DataFrame:
    """Add the parameters of each question; what is not mentioned is NULL."""
    return (
        _lowered(df)
        .withColumns(question_parameters("question", "_lowered"))
        .withColumns({**age_range("_lowered"), "weekly_capacity": F.col("baseline_capacity")})
        .drop("_lowered")
    )


def route_questions(df: DataFrame) -> DataFrame:
    """Add type and report of each question."""
    return (
        _lowered(df)
        .withColumn("question_type", question_type("_lowered"))
        .withColumn("report", question_report(F.col("question_type"), "_lowered"))
        .drop("_lowered")
    )


def with_requests(df: DataFrame) -> DataFrame:
    """Add the report, its parameters and a text key equal for equal requests."""
    report = F.col("report")
    takes_specialties = report.isin(*SPECIALTY_REPORTS, *AGE_REPORTS) | report.isin(
        "high_risk_patients", "seasonal_analysis"
    )
    by_age = report.isin(AGE_REPORTS)
    percentage = (
        F.when(report == "high_risk_patients", F.coalesce("percentage", F.lit(V.DEFAULT_RISK_PERCENTAGE)))
        .when(
            report.isin("cancellation_whatif", "capacity_answer"),
            F.coalesce("percentage", F.lit(V.DEFAULT_PERCENTAGE)),
        )
    )
    ranged = F.col("age_min").isNotNull() & F.col("age_max").isNotNull()

    def bound(side: str) -> Column:
        return F.when(by_age, F.coalesce("age", F.when(ranged, F.col(side))))

    requested = extract_parameters(route_questions(df)).select(
        *df.columns,
        "question_type",
        "report",
        F.when(takes_specialties, F.col("specialties")).alias("specialties"),
        F.when(report == "seasonal_analysis", F.col("seasons")).alias("seasons"),
        bound("age_min").alias("age_min"),
        bound("age_max").alias("age_max"),
        percentage.alias("percentage"),
        F.when(report == "capacity_answer", F.col("baseline_capacity")).alias("baseline_capacity"),
    )

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("-"))

    return requested.withColumn(
        "request",
        F.concat_ws(
            "|",
            report,
            F.coalesce(F.array_join("specialties", ","), F.lit("-")),
            F.coalesce(F.array_join("seasons", ","), F.lit("-")),
            text("age_min"),
            text("age_max"),
            text("percentage"),
            text("baseline_capacity"),
        ),
    )


def _pairs(metrics: dict[str, str]) -> str:
    """SQL array of (metric, value) structs."""
    rows = ", ".join(
        f"named_struct('metric', '{name}', 'value', cast({value} as double))"
        for name, value in metrics.items()
    )
    return f"array({rows})"


def _long(df: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    return df.selectExpr(
        "request", "report", f"cast({key} as string) as key", f"inline({_pairs(metrics)})"
    )


def _long_by_report(df: DataFrame, key: str, metrics: dict[str, dict[str, str]]) -> DataFrame:
    """Long rows whose metrics depend on the report of the row."""
    cases = " ".join(f"when '{name}' then {_pairs(m)}" for name, m in metrics.items())
    return df.selectExpr(
        "request", "report", f"cast({key} as string) as key", f"inline(case report {cases} end)"
    )


def _scoped(column: str) -> Column:
    """A value counts for itself and for the whole; a missing one for the whole only."""
    return F.explode(F.array_compact(F.array(F.col(column), F.lit(ALL))))


def _wanted(column: str) -> Column:
    """The values a request names, or the whole if it names none."""
    return F.explode(F.coalesce(F.col(column), F.array(F.lit(ALL))))


# what is summed in every cell, by the name of the sum
SUMMED = {
    "wait": "wait_days",
    "los": "los",
    "cost": "cost_estimate",
    "cancel": "cancel_risk",
    "readmit": "readmit_risk",
    "loss": "cost_estimate * cancel_risk",
}
CELL_SUMS = ["rows", "n", *[part for name in SUMMED for part in exact.part_names(name)]]


def patient_cells(patients: DataFrame) -> DataFrame:
    """Sums and counts of every age, season and specialty: what most reports read.

    The size depends on how many ages, seasons and specialties there are, not on the
    number of patients. Sums are kept in exact parts, so that cells can be added up, and
    taken from each other, in any order.
    """
    sums = [x for name, value in SUMMED.items() for x in exact.part_sums(name, F.expr(value))]
    return patients.groupBy("age", "season", "specialty").agg(
        F.count("*").alias("rows"), F.count("patient_id").alias("n"), *sums
    )


def _summed_up() -> list[Column]:
    return [F.sum(c).alias(c) for c in CELL_SUMS]


def _figures(cells: DataFrame) -> DataFrame:
    """The sums of added cells, by their names, and their means, ``mean_<name>``."""
    figures = {name: exact.of_parts(name) for name in SUMMED}
    means = {f"mean_{name}": exact.mean_of_parts(name) for name in SUMMED}
    return cells.withColumns({**figures, **means})


def _total(name: str) -> str:
    return f"coalesce({name}, 0D)"


def _specialty_answers(requests: DataFrame, cells: DataFrame) -> DataFrame:
    # one row per specialty, and again for requests that want all of them
    totals = _figures(
        cells.where(F.col("specialty").isNotNull()).groupBy("specialty").agg(*_summed_up())
    ).withColumn("scope", _scoped("specialty"))
    asked = requests.where(F.col("report").isin(SPECIALTY_REPORTS)).select(
        "request", "report", _wanted("specialties").alias("scope")
    )
    metrics = {
        "average_wait_time": {"avg_wait_days": "mean_wait", "patient_count": "n"},
        "specialty_analysis": {
            "patient_count": "n",
            "avg_wait_days": "mean_wait",
            "avg_cost": "mean_cost",
            "avg_cancel_risk": "mean_cancel",
            "avg_readmit_risk": "mean_readmit",
        },
        "cost_impact": {
            "total_cost": _total("cost"),
            "avg_cost": "mean_cost",
            "patient_count": "cost_n",
            "potential_loss_from_cancellations": _total("loss"),
        },
    }
    return _long_by_report(asked.join(totals, "scope"), "specialty", metrics)


def high_risk_totals(patients: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Sums over patients above each threshold, by specialty.

    ``thresholds`` has a distinct column ``threshold``. Risks and thresholds are sorted
    together; the thresholds counted up to a risk are its place. Running sums down from
    the highest place then answer each threshold without pairing patients and thresholds.
    """
    # no risk is above 1
    marks = thresholds.where("threshold < 1").select(
        F.col("threshold").alias("value"), F.lit(1).alias("is_threshold")
    )
    placeable = patients.where(F.col("specialty").isNotNull() & F.col("readmit_risk").isNotNull())
    sums = ["n", "rows", *exact.part_names("risk"), *exact.part_names("cost")]
    by_risk = written(
        placeable.groupBy("specialty", F.col("readmit_risk").alias("value")).agg(
            F.count("patient_id").alias("n"),
            F.count("*").alias("rows"),
            *exact.part_sums("risk", F.col("readmit_risk")),
            *exact.part_sums("cost", F.col("cost_estimate")),
        ),
        "risks",
    )
    risks = by_risk.select("value").distinct().withColumn("is_threshold", F.lit(0))
    # a risk equal to a threshold is not above it and so comes first
    places = running_sums(
        marks.union(risks).withColumn("all", F.lit(True)),
        F.col("value"),
        F.col("is_threshold"),
        sums={"place": "is_threshold"},
        by="all",
    ).drop("all")
    placed = (
        by_risk.join(places.where("is_threshold = 0").select("value", "place"), "value")
        .where(F.col("place") > 0)
        .groupBy("specialty", "place")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    down = running_sums(
        placed.withColumn("at", F.lit(1)),
        F.desc("place"),
        sums={c: c for c in [*sums, "at"]},
        by="specialty",
    )
    lower = down.select("specialty", (F.col("at") - 1).alias("at"), F.col("place").alias("lower"))
    ranged = down.join(lower, ["specialty", "at"], "left").withColumn(
        "lower", F.coalesce("lower", F.lit(0))
    )
    numbered = places.where("is_threshold = 1").select(F.col("value").alias("threshold"), "place")
    return numbered.join(_each_place(ranged), "place").select(
        "threshold",
        "specialty",
        F.col("n").alias("high_risk_count"),
        exact.mean_of_parts("risk").alias("avg_risk"),
        exact.mean_of_parts("cost").alias("avg_cost"),
    )


#: Places that one row of a block stands for before it is spread out.
PLACES_IN_BLOCK = 1000


def _each_place(ranged: DataFrame) -> DataFrame:
    """A row for each place above ``lower`` up to ``place``. Blocks of places are dealt out
    before they are spread, so that no row holds them all and no task makes them all."""
    block = F.sequence(
        F.expr(f"lower div {PLACES_IN_BLOCK}"), F.expr(f"(place - 1) div {PLACES_IN_BLOCK}")
    )
    dealt = ranged.withColumn("_block", F.explode(block)).repartition("_block", "specialty")
    first = F.col("_block") * PLACES_IN_BLOCK
    reached = F.sequence(
        F.greatest(F.col("lower"), first) + 1, F.least("place", first + PLACES_IN_BLOCK)
    )
    return dealt.withColumn("place", F.explode(reached)).drop("_block", "lower")


def _high_risk_answers(requests: DataFrame, patients: DataFrame) -> DataFrame:
    asked = requests.where(F.col("report") == "high_risk_patients").select(
        "request",
        "report",
        (F.col("percentage") / 100).alias("threshold"),
        _wanted("specialties").alias("scope"),
    )
    totals = high_risk_totals(patients, asked.select("threshold").distinct()).withColumn(
        "scope", _scoped("specialty")
    )
    return _long(
        asked.join(totals, ["threshold", "scope"]),
        "specialty",
        {c: c for c in ["high_risk_count", "avg_risk", "avg_cost"]},
    )


def _seasonal_answers(requests: DataFrame, cells: DataFrame) -> DataFrame:
    scoped = (
        cells.where(F.col("season").isNotNull())
        .groupBy("season", "specialty")
        .agg(*_summed_up())
        .withColumn("specialty_scope", _scoped("specialty"))
        .withColumn("season_scope", _scoped("season"))
    )
    asked = (
        requests.where(F.col("report") == "seasonal_analysis")
        .withColumn("specialty_scope", _wanted("specialties"))
        .withColumn("season_scope", _wanted("seasons"))
        .select("request", "report", "specialty_scope", "season_scope")
    )
    found = _figures(
        asked.join(scoped, ["specialty_scope", "season_scope"])
        .groupBy("request", "report", "season")
        .agg(*_summed_up())
    )
    return _long(
        found,
        "season",
        {
            "avg_cancel_risk": "mean_cancel",
            "avg_readmit_risk": "mean_readmit",
            "avg_cost": "mean_cost",
            "total_cases": "n",
        },
    )


def age_sums(cells: DataFrame) -> DataFrame:
    """Sums over all ages up to each, by specialty and for all of them.

    One row per specialty and age from 0 to the last that belongs to a group. The sums of
    a range of ages are those up to its end less those up to the age before it.
    """
    oldest = V.AGE_BINS[-1][1]
    scoped = (
        cells.where(F.col("age").between(0, oldest))
        .groupBy("age", "specialty")
        .agg(*_summed_up())
        .withColumn("scope", _scoped("specialty"))
        .groupBy("scope", "age")
        .agg(*_summed_up())
    )
    every = (
        scoped.select("scope")
        .distinct()
        .withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(oldest))))
    )
    # as many rows in a window as there are ages
    up_to = Window.partitionBy("scope").orderBy("age")
    return every.join(scoped, ["scope", "age"], "left").select(
        "scope",
        "age",
        *[
            F.sum(F.coalesce(c, F.lit(0))).over(up_to).alias(c)
            for c in CELL_SUMS
        ],
    )


def _age_answers(requests: DataFrame, cells: DataFrame) -> DataFrame:
    sums = written(age_sums(cells), "ages")
    low, high = F.col("age_min"), F.col("age_max")
    bins = ", ".join(
        f"named_struct('after', {after}, 'last', {last}, 'age_group', '{name}')"
        for after, last, name in V.AGE_BINS
    )
    # a range is cut at the ends of the age groups; no bounds are those of the group
    asked = (
        requests.where(F.col("report").isin(AGE_REPORTS))
        .withColumn("scope", _wanted("specialties"))
        .select("request", "report", "scope", "age_min", "age_max", F.expr(f"inline(array({bins}))"))
        .withColumns(
            {
                "after": F.greatest(F.col("after"), F.coalesce(low - 1, F.col("after"))),
                "last": F.least(F.col("last"), F.coalesce(high, F.col("last"))),
            }
        )
        .where("after < last")
        .drop("age_min", "age_max")
    )
    # two lookups give the sums of a range
    upper = sums.select("scope", F.col("age").alias("last"), *[F.col(c).alias(f"to_{c}") for c in CELL_SUMS])
    below = sums.select("scope", F.col("age").alias("after"), *[F.col(c).alias(f"of_{c}") for c in CELL_SUMS])
    ranges = (
        asked.join(upper, ["scope", "last"])
        .join(below, ["scope", "after"])
        .select(
            "request",
            "report",
            "age_group",
            *[(F.col(f"to_{c}") - F.col(f"of_{c}")).alias(c) for c in CELL_SUMS],
        )
    )
    found = _figures(
        ranges.groupBy("request", "report", "age_group").agg(*_summed_up()).where("rows > 0")
    ).where((F.col("report") != "age_based_cost") | (F.col("cost_n") > 0))
    metrics = {
        "age_based_risk": {
            "avg_readmit_risk": "mean_readmit",
            "total_patients": "n",
        },
        "age_based_cancellation": {
            "avg_cancel_risk": "mean_cancel",
            "total_patients": "n",
        },
        "age_based_cost": {
            "avg_cost": "mean_cost",
            "total_cost": "cost",
            "patient_count": "cost_n",
        },
    }
    return _long_by_report(found, "age_group", metrics)


def _cancellation_answers(requests: DataFrame, cells: DataFrame) -> DataFrame:
    # the report name joins one row of sums to every reduction asked for
    sums = _figures(cells.agg(*_summed_up())).withColumn("report", F.lit("cancellation_whatif"))
    expected = _total("cancel")
    prevented = f"{expected} * (percentage / 100)"
    bed_days = f"{prevented} * mean_los"
    return _long(
        requests.where(F.col("report") == "cancellation_whatif").join(sums, "report"),
        "''",
        {
            "reduction_percentage": "percentage",
            "current_expected_cancellations": f"bround({expected}, 2)",
            "cancellations_prevented": f"bround({prevented}, 2)",
            "cost_savings": f"bround({prevented} * mean_cost, 2)",
            "bed_days_freed": f"bround({bed_days}, 2)",
            "weekly_capacity_freed": f"bround({bed_days} / 7 * 5, 2)",
        },
    )


CAPACITY_METRICS = [
    "weeks_saved",
    "patients_moved_earlier",
    "baseline_weeks",
    "new_weeks",
    "baseline_capacity",
    "new_capacity",
    "additional_capacity",
    "uplift_percentage",
    "efficiency_gain",
    "total_patients",
    "current_doctors",
    "current_nurses",
    "patients_per_doctor",
    "patients_per_nurse",
    "additional_doctors_needed",
    "additional_nurses_needed",
    "mixed_doctors",
    "mixed_nurses",
    "cost_doctors_only",
    "cost_nurses_only",
    "cost_mixed",
]


def _capacity_answers(requests: DataFrame, cells: DataFrame) -> DataFrame:
    total = cells.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_patients")).withColumn(
        "report", F.lit("capacity_answer")
    )
    rows = (
        # a week without any places never ends
        requests.where((F.col("report") == "capacity_answer") & (F.col("baseline_capacity") > 0))
        .join(total, "report")
        .select(
            "request",
            "report",
            "total_patients",
            "baseline_capacity",
            F.col("percentage").alias("uplift_percentage"),
        )
    )
    return _long(capacity_answer_columns(rows), "''", {c: c for c in CAPACITY_METRICS})


def _preview_answers(requests: DataFrame, patients: DataFrame, size: int) -> DataFrame:
    first = preview(patients.select("patient_id", *PREVIEW_METRICS), size).withColumn(
        "report", F.lit("preview")
    )
    return _long(
        requests.where(F.col("report") == "preview").join(first, "report"),
        "patient_id",
        {c: c for c in PREVIEW_METRICS},
    )


def _written_requests(questions: DataFrame) -> DataFrame:
    """Questions with their requests, read from their texts once, where these lie."""
    texts = dealt_out_if_small(questions.select("question_id", "question"))
    return written(with_requests(texts).drop("question"), "questions")


REQUEST = [
    "request",
    "report",
    "specialties",
    "seasons",
    "age_min",
    "age_max",
    "percentage",
    "baseline_capacity",
]
#: What answers read of a patient.
PATIENT_COLUMNS = ["patient_id", "specialty", "season", *PREVIEW_METRICS]


def request_table(requested: DataFrame) -> DataFrame:
    """The distinct requests with the number of questions that ask each, ``asked``."""
    return written(
        requested.groupBy(*REQUEST).agg(F.count("*").alias("asked")), "requests"
    )


def answer_requests(
    requests: DataFrame, patients: DataFrame, preview_size: int = PREVIEW_SIZE
) -> DataFrame:
    """Answers of a request table: request, report, key, metric, value.

    The requests and the patient cells are written once and read by every family of
    reports that was asked for.
    """
    # at most the eleven names of reports; families nobody asked for are left out
    asked = {row.report for row in requests.select("report").distinct().collect()}
    families = []
    of_cells = [f for names, f in _CELL_FAMILIES if asked & set(names)]
    if of_cells:
        families.append(lambda: _of_cells(of_cells, requests, patients))
    if "high_risk_patients" in asked:
        families.append(lambda: [_high_risk_answers(requests, patients)])
    if "preview" in asked:
        families.append(lambda: [_preview_answers(requests, patients, preview_size)])
    answers = [answer for family in at_the_same_time(*families) for answer in family]
    if not answers:
        return requests.sparkSession.createDataFrame([], ANSWER_SCHEMA)
    return reduce(DataFrame.unionByName, answers)


def _of_cells(families: list, requests: DataFrame, patients: DataFrame) -> list[DataFrame]:
    cells = written(patient_cells(patients), "cells")
    return [family(requests, cells) for family in families]


_CELL_FAMILIES = [
    (SPECIALTY_REPORTS, _specialty_answers),
    (["seasonal_analysis"], _seasonal_answers),
    (AGE_REPORTS, _age_answers),
    (["cancellation_whatif"], _cancellation_answers),
    (["capacity_answer"], _capacity_answers),
]
ANSWER_SCHEMA = "request string, report string, key string, metric string, value double"


def stored_patients(patients: DataFrame) -> DataFrame:
    """What answers read of the patients, evaluated once; several families read it."""
    return written(patients.select(*PATIENT_COLUMNS), "patients")


def answers_by_request(
    questions: DataFrame, patients: DataFrame, preview_size: int = PREVIEW_SIZE
) -> DataFrame:
    """Answers at the grain of requests: request, report, asked, key, metric, value.

    However many questions ask for the same thing, it is answered in as many rows as the
    report has; ``asked`` is the number of those questions. ``requests_of`` tells which
    question asks for which request. Requests whose report finds nothing have no rows.
    """
    requests = request_table(_written_requests(questions))
    answers = answer_requests(requests, patients, preview_size)
    return answers.join(requests.select("request", "asked"), "request").select(
        "request", "report", "asked", "key", "metric", "value"
    )


def requests_of(questions: DataFrame) -> DataFrame:
    """question_id, question_type, report and request of every question."""
    return with_requests(questions).select("question_id", "question_type", "report", "request")


#: A request that more than one question in so many asks is spread over ``SALTS`` keys.
#: There can be no more such requests than this, whatever the number of questions.
HOT_SHARE = 1000
SALTS = 64


def _salted(requested: DataFrame, requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of questions joined with the answers of their requests, whatever the skew.

    Questions of a hot request are dealt out over salts, and its answers, a few rows, are
    repeated for each salt.
    """
    total = requests.agg(F.sum("asked")).first()[0] or 0
    # fewer than HOT_SHARE rows
    hot = F.broadcast(
        requests.where(F.col("asked") * HOT_SHARE > total).select(
            "request", F.lit(True).alias("_hot")
        )
    )
    salt = F.pmod(F.xxhash64("question_id"), F.lit(SALTS)).cast("int")
    left = (
        requested.join(hot, "request", "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = (
        answers.join(hot, "request", "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    )
    return left.join(right, ["request", "_salt"]).drop("_salt")


def answer_questions(
    questions: DataFrame, patients: DataFrame, preview_size: int = PREVIEW_SIZE
) -> DataFrame:
    """Answers in long form: question_id, report, key, metric, value.

    A question whose report finds nothing has no rows.
    """
    requested = _written_requests(questions)
    requests = request_table(requested)
    answers = answer_requests(requests, patients, preview_size)
    return _salted(requested.select("question_id", "request"), requests, answers).select(
        "question_id", "report", "key", "metric", "value"
    )


def ask(text: str, patients: DataFrame) -> DataFrame:
    """Answer of a single question, in the form of ``answer_questions``."""
    one = patients.sparkSession.createDataFrame([(1, text)], "question_id long, question string")
    return answer_questions(one, patients)


def _amount(column: str, decimals: int) -> Column:
    return F.format_number(column, decimals)


def _plain(column: Column | str, decimals: int) -> Column:
    return F.replace(F.format_number(column, decimals), F.lit(","), F.lit(""))


def _cancellation_text() -> Column:
    return F.concat(
        F.lit("Reducing cancellations by "),
        _plain("reduction_percentage", 1),
        F.lit("% saves £"),
        _amount("cost_savings", 2),
        F.lit(", frees "),
        _plain("bed_days_freed", 0),
        F.lit(" bed days and "),
        _plain("weekly_capacity_freed", 1),
        F.lit(" procedures a week, and prevents "),
        _plain("cancellations_prevented", 0),
        F.lit(" cancellations."),
    )


def _capacity_text() -> Column:
    def team(label: str, doctors: str | None, nurses: str | None, cost: str) -> list[Column]:
        parts = []
        if doctors:
            parts += [F.lit(" +"), _plain(doctors, 1), F.lit(" doctors")]
        if nurses:
            parts += [F.lit(" +"), _plain(nurses, 1), F.lit(" nurses")]
        return [F.lit(f" {label}:"), *parts, F.lit(" for £"), _amount(cost, 0), F.lit(" a year.")]

    return F.concat(
        F.lit("Raising weekly capacity from "),
        _plain("baseline_capacity", 0),
        F.lit(" to "),
        _plain("new_capacity", 0),
        F.lit(" (+"),
        _plain("additional_capacity", 0),
        F.lit(") clears the backlog in "),
        _plain("new_weeks", 0),
        F.lit(" instead of "),
        _plain("baseline_weeks", 0),
        F.lit(" weeks ("),
        _plain("weeks_saved", 0),
        F.lit(" saved, "),
        _plain("efficiency_gain", 1),
        F.lit("%) and moves "),
        _plain("patients_moved_earlier", 0),
        F.lit(" patients to earlier slots. Current need: "),
        _plain("current_doctors", 1),
        F.lit(" doctors, "),
        _plain("current_nurses", 1),
        F.lit(" nurses ("),
        _plain("patients_per_doctor", 0),
        F.lit(" and "),
        _plain("patients_per_nurse", 0),
        F.lit(" patients each)."),
        *team("Doctors only", "additional_doctors_needed", None, "cost_doctors_only"),
        *team("Nurses only", None, "additional_nurses_needed", "cost_nurses_only"),
        *team("Mixed (recommended)", "mixed_doctors", "mixed_nurses", "cost_mixed"),
    )


def format_answers(
    questions: DataFrame, patients: DataFrame, preview_size: int = PREVIEW_SIZE
) -> DataFrame:
    """One line of text per question: question_id, question_type, report, answer.

    What-if answers are sentences; table answers say how many records were found and list
    them by key, with metrics rounded to four decimals.
    """
    requested = _written_requests(questions)
    requests = request_table(requested)
    answers = answer_requests(requests, patients, preview_size)
    figures = ["reduction_percentage", "cost_savings", "bed_days_freed",
               "weekly_capacity_freed", "cancellations_prevented", *CAPACITY_METRICS]
    is_text = F.col("report").isin("cancellation_whatif", "capacity_answer")
    sentences = (
        answers.where(is_text)
        .groupBy("request", "report")
        .agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in figures])
        .select(
            "request",
            F.when(F.col("report") == "capacity_answer", _capacity_text())
            .otherwise(_cancellation_text())
            .alias("answer"),
        )
    )
    shown = F.coalesce(_plain("value", 4), F.lit("missing"))
    # a request has one line per specialty, season, age group or previewed patient
    lines = (
        answers.where(~is_text)
        .groupBy("request", "key")
        .agg(
            F.array_join(
                F.array_sort(
                    F.collect_list(
                        F.concat("metric", F.lit("="), shown)
                    )
                ),
                ", ",
            ).alias("line")
        )
        .groupBy("request")
        .agg(
            F.concat(
                F.lit("Found "),
                F.count("*").cast("string"),
                F.lit(" records. "),
                F.array_join(
                    F.array_sort(F.collect_list(F.concat("key", F.lit(": "), "line"))), "; "
                ),
            ).alias("answer")
        )
    )
    # a line for every request, so that the questions meet each of theirs once
    texts = requests.select("request").join(sentences.unionByName(lines), "request", "left")
    asked = requested.select("question_id", "question_type", "report", "request")
    return _salted(asked, requests, written(texts, "texts")).select(
        "question_id",
        "question_type",
        "report",
        F.coalesce("answer", F.lit("No results found for this question.")).alias("answer"),
    )
