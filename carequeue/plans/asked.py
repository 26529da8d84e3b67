"""Questions, searches and typed text that Spark derives from the patient table.

Used by the registered queries, so that what they read grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V
from carequeue.operators.lookup import glossary
from carequeue.operators.rank import rank_rows
from carequeue.sources.tables import load_table

# A word of a text: characters between spaces and marks.
WORD = "[^ .,;:!?\n]+"

# Question forms; one per patient, filled from the patient's own columns.
QUESTION_FORMS = [
    "What is the average wait time for {specialty}?",
    "Average waiting days in Urology and {specialty}",
    "What is the cost impact for {specialty}?",
    "Show the specialty analysis, please",
    "Department summary for {specialty}",
    "Show me high risk patients with readmission risk above {n}%",
    "High risk cases in {specialty} above {n}.5%",
    "What is the wait time for high risk patients?",
    "Reduce cancellations by {n}%",
    "Could a reduction of cancellations reach 7.5%?",
    "Impact of Baseline capacity {cap} and Capacity Increase by {n}%",
    "What happens if we increase capacity by {n}%?",
    "Boost theatres by {n}%",
    "Show seasonal analysis for {season}",
    "{season} and Winter readmission in {specialty}",
    "Seasonal cost of {specialty}",
    "Which season has the highest numbers?",
    "Show readmission risk for elderly patients?",
    "Risk analysis for patients aged {age}?",
    "Readmission of people between {age} and 90 in {specialty}, by segment",
    "Which age group would cancel in {specialty}?",
    "Would a child or a senior person cancel?",
    "What is the average cost for young adults?",
    "Cost for middle-aged adult people, risk weight 0.4, threshold 0.8",
    "Show staffing requirements for capacity increase",
    "Uplift in nurse posts",
    "Capacity and nurse posts",
    "Compare performance across specialties",
]

# Search forms: exact, partial, contained, title, unknown and blank ones.
SEARCH_FORMS = [
    "{specialty}",
    "  {SPECIALTY} ",
    "surg",
    "mellitus",
    "clinic for {specialty} in {season}",
    "gynec",
    "xyz",
    "my asthma",
    " ",
]


def _fill(forms: list[str], row: Column) -> Column:
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), row.cast("int") + 1)
    values = {
        "{specialty}": F.col("specialty"),
        "{SPECIALTY}": F.upper("specialty"),
        "{season}": F.col("season"),
        "{n}": (F.lit(5) + F.col("patient_id") % 85).cast("string"),
        "{cap}": (F.lit(50) + F.col("patient_id") % 9 * 50).cast("string"),
        "{age}": F.col("age").cast("string"),
    }
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def patient_questions(patients: DataFrame) -> DataFrame:
    """One question per patient: question_id, question."""
    form = F.pmod("patient_id", F.lit(len(QUESTION_FORMS)))
    return patients.select(
        F.col("patient_id").alias("question_id"), _fill(QUESTION_FORMS, form).alias("question")
    )


def patient_searches(patients: DataFrame) -> DataFrame:
    """One glossary search per patient."""
    form = F.pmod("patient_id", F.lit(len(SEARCH_FORMS)))
    return patients.select("patient_id", _fill(SEARCH_FORMS, form).alias("search"))


def typed_questions(patients: DataFrame) -> DataFrame:
    """The patients' questions as far as typed: their first 1 to 20 letters."""
    asked = patient_questions(patients)
    length = (F.lit(1) + F.pmod(F.col("question_id") * 7, F.lit(20))).cast("int")
    return asked.select(
        "question_id", F.substring("question", F.lit(1), length).alias("typed")
    )


def whole_and_prefixes(patients: DataFrame) -> DataFrame:
    """What is in the box while a question is typed: its beginning, and all of it."""
    whole = patient_questions(patients).select("question_id", F.col("question").alias("typed"))
    return typed_questions(patients).union(whole)


def asked_before(patients: DataFrame) -> DataFrame:
    """The distinct questions of all patients as suggestions, the most frequent first."""
    counted = patient_questions(patients).groupBy(F.col("question").alias("suggestion")).agg(
        F.count("*").alias("n")
    )
    order = (F.desc("n"), F.asc("suggestion"))
    return rank_rows(counted, *order, position="position").select("position", "suggestion")


def terms_and_words(spark: SparkSession, folder: str) -> DataFrame:
    """A long glossary: the fixed one, then the words of the benchmark in order."""
    fixed = glossary(spark).select("position", "term", "title", "url")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    named = load_table(spark, folder, "benchmark").select(words.alias("term")).distinct()
    ranked = rank_rows(named, F.col("term").asc(), position="position")
    return fixed.union(
        ranked.select(
            F.col("position") + len(V.MEDICAL_TERMS) - 1,
            "term",
            F.concat(F.lit("The word "), F.col("term")),
            F.lit(None).cast("string"),
        )
    )
