import random
import re
import time

import pytest
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V
from carequeue.functions.scoring import score_patients
from carequeue.operators import questions as Q
from carequeue.operators import reports as R
from carequeue.operators.capacity import Scenario, capacity_answer
from carequeue.operators.normalize import normalize_patients


@pytest.fixture
def ask(spark):
    return lambda *texts: spark.createDataFrame(
        [(i, t) for i, t in enumerate(texts)], "question_id long, question string"
    )


def test_words_are_looked_for_before_patterns(spark):
    """Texts without the words never reach a pattern, and types are those of the patterns."""
    rng = random.Random(8)
    lists = " ".join(p for _, p in V.QUESTION_PATTERNS).replace("high.risk", "high-risk highrisk high\nrisk")
    words = [*re.findall(r"[a-z][a-z\n-]*", lists), "20", "7%", "x", "\n", ".", "highly", "costs"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, question string")
    typed = Q.classify_questions(df)
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") > plan.count("RLIKE") == len(V.QUESTION_PATTERNS)
    for r in typed.collect():
        lines = (r.question or "").split("\n")
        of = [name for name, p in V.QUESTION_PATTERNS if any(re.search(p, line) for line in lines)]
        assert r.question_type == (of[0] if of else V.DEFAULT_QUESTION_TYPE), r.question


GOLDEN = [
    ("What is the average wait time for Cardiology and Orthopedics?", "average_wait_time"),
    ("What is the wait time for high risk patients?", "high_risk_patients"),
    ("Show me high risk patients with readmission risk above 70%", "high_risk_patients"),
    ("Reduce cancellations by 15%", "cancellation_reduction"),
    ("What is the cost impact for Orthopedics?", "cost_impact"),
    ("Show seasonal analysis for Winter", "seasonal_analysis"),
    ("Impact of Baseline capacity 200 and Capacity Increase by 20%", "capacity_analysis"),
    ("What happens if we increase capacity by 25%?", "capacity_analysis"),
    ("What is the average cost for young adults?", "age_based_cost"),
    ("What is the average cost for adults?", "age_based_cost"),
    ("Show readmission risk for elderly patients?", "age_based_risk"),
    ("Risk analysis for patients aged 65?", "age_based_risk"),
    ("Show staffing requirements for capacity increase", "staffing_analysis"),
    ("Impact of 10% cancellation reduction?", "general_analysis"),
    ("Show analysis by age group", "general_analysis"),
    ("Compare performance across specialties", "general_analysis"),
    ("Optimize schedule for next week", "general_analysis"),
    ("", "general_analysis"),
]


def test_golden_types(ask):
    found = Q.classify_questions(ask(*[t for t, _ in GOLDEN])).orderBy("question_id").collect()
    assert [(r.question, r.question_type) for r in found] == GOLDEN


def test_types_of_all_suggestions_match_python_search(ask):
    rows = Q.classify_questions(ask(*V.SUGGESTIONS)).collect()
    for r in rows:
        types = [n for n, p in V.QUESTION_PATTERNS if re.search(p, r.question.lower())]
        assert r.question_type == [*types, V.DEFAULT_QUESTION_TYPE][0]


def python_type(text):
    found = (n for n, p in V.QUESTION_PATTERNS if re.search(p, text.lower()))
    return next(found, V.DEFAULT_QUESTION_TYPE)


def python_number(pattern, text):
    found = re.search(pattern, text)
    return float(found.group(1)) if found else None


def test_keywords_in_any_order_match_python_search(ask):
    """Texts of pattern words, numbers and line ends, as the plain patterns read them."""
    words = sorted({w for _, p in V.QUESTION_PATTERNS for w in re.findall(r"[a-z-]{3,}", p)})
    words += ["7", "12.5", "3%", "1.2.3%", "4.%", "\n", "\n", " ", "high risk", "high\nrisk",
              "baseline capacity", "baseline  \n capacity", "baseline\tcapacity", "risk-weight",
              "risk\nweight", "threshold", "middle-aged", "\r", "\u2028", "x"]
    rng = random.Random(4)
    texts = [
        "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9)))
        for _ in range(3000)
    ]
    for _, p in V.QUESTION_PATTERNS:
        own = re.findall(r"[a-z-]{3,}", p)
        texts += [
            " ".join(rng.choice([*own, *own, "7", "\n", "or"]) for _ in range(rng.randrange(2, 6)))
            for _ in range(150)
        ]
    texts += ["risk\nage", "age 5 risk", "capacity\n5", "capacity 5", "5 capacity", "agecost"]
    rows = Q.extract_parameters(Q.classify_questions(ask(*texts))).collect()
    for r in rows:
        low = r.question.lower()
        assert r.question_type == python_type(r.question), repr(r.question)
        assert r.percentage == python_number(V.PERCENT_PATTERN, r.question), repr(r.question)
        assert r.risk_weight == python_number(V.RISK_WEIGHT_PATTERN, low), repr(r.question)
        assert r.threshold == python_number(V.THRESHOLD_PATTERN, low), repr(r.question)
        baseline = python_number(V.BASELINE_PATTERN, low)
        if baseline is None and ("capacity" in low or "increase" in low):
            baseline = V.DEFAULT_BASELINE
        assert r.baseline_capacity == baseline, repr(r.question)
    assert len({r.question_type for r in rows}) == len(V.QUESTION_PATTERNS) + 1


LONG = [
    *["{} ".format(" ".join(re.findall(r"[a-z-]{3,}", p)[:-1])) for _, p in V.QUESTION_PATTERNS],
    "average wait ", "young patients wait on average, ", "reduce cancel ", "baseline capacity ",
    "baseline ", "baseline\n", "risk weight ", "threshold ", "1", "1.", "between 1 ", "age ", " ",
    "high risk\n", "entt ", "seniors ",
]


def test_megabytes_take_their_length_in_time(ask):
    """Words that lead a backtracking search astray, repeated without what would end it."""
    df = ask(*[words * (1_000_000 // len(words)) for words in LONG]).repartition(8)
    started = time.monotonic()
    Q.route_questions(df).drop("question").collect()
    Q.extract_parameters(df).drop("question").collect()
    # some thirty texts of a megabyte, twenty patterns each; one took minutes by backtracking
    assert time.monotonic() - started < 3 * len(LONG)


PARAMETERS = [
    ("high risk above 70.5% or 80%", {"percentage": 70.5, "numbers": [70.5, 80.0]}),
    ("Impact of Baseline capacity 200 and 3", {"baseline_capacity": 200, "weekly_capacity": 200}),
    ("increase it", {"baseline_capacity": 100, "weekly_capacity": 100}),
    ("risk weight of 0.4, threshold at 2", {"risk_weight": 0.4, "threshold": 2.0}),
    ("ENT, general surgery and CARDIOLOGY", {"specialties": ["Cardiology", "ENT", "General Surgery"]}),
    ("patients went absent", {"specialties": None}),
    ("urologys", {"specialties": None}),
    ("winter and Autumn, not springs", {"seasons": ["Winter", "Autumn"]}),
    ("aged 65", {"age": 65}),
    ("age66 and age 67", {"age": 66}),
    ("average 65", {"age": None}),
    ("between 20 and 30", {"age_min": 20, "age_max": 30, "age_group": None}),
    ("between 20 to 30", {"age_min": 20, "age_max": 30}),
    ("a child between 20 and 30", {"age_min": 0, "age_max": 17, "age_group": "child"}),
    ("young adult", {"age_min": 36, "age_max": 60, "age_group": "adult"}),
    ("young people", {"age_min": 18, "age_max": 35, "age_group": "young"}),
    ("senior or middle-aged", {"age_min": 40, "age_max": 60, "age_group": "middle-aged"}),
    ("adults", {"age_min": None, "age_group": None}),
    ("nothing here", {"percentage": None, "numbers": None, "baseline_capacity": None}),
    ("baseline capacity 99999999999999999999", {"baseline_capacity": None}),
]


def test_parameters(ask):
    rows = Q.extract_parameters(ask(*[t for t, _ in PARAMETERS])).orderBy("question_id").collect()
    for row, (text, expected) in zip(rows, PARAMETERS):
        assert {k: row[k] for k in expected} == expected, text


def test_routes(ask):
    texts = {
        "Reduce cancellations by 15%": "cancellation_whatif",
        "Increase capacity by 10% to reduce cancellations": "cancellation_whatif",
        "increase capacity by 25%": "capacity_answer",
        "Boost theatres by 10": "preview",
        "Capacity and nurse posts": "capacity_answer",
        "Uplift in nurse posts": "preview",
        "Show staffing requirements": "preview",
        "winter readmission": "seasonal_analysis",
        "what season is worst": "seasonal_analysis",
        "high risk case": "high_risk_patients",
        "hello": "preview",
    }
    rows = Q.route_questions(ask(*texts)).orderBy("question_id").collect()
    assert {r.question: r.report for r in rows} == texts


@pytest.fixture
def people(spark):
    """Scored patients with missing values and ties."""
    df = spark.range(400).selectExpr(
        "id + 1 as patient_id",
        "cast(id * 37 % 123 as int) as age",
        "if(id % 11 = 0, null, element_at(array('ENT', 'Cardiology', 'Urology', 'Podiatry'),"
        " cast(id % 4 as int) + 1)) as specialty",
        "'F' as gender",
        "if(id % 13 = 0, null, element_at(array('Winter', 'Spring', 'Summer', 'Autumn'),"
        " cast(id % 3 as int) + 1)) as season",
        "if(id % 17 = 0, null, cast(id % 9 as double)) as los",
        "if(id % 19 = 0, null, cast(1000 + id * 91 % 8000 as double)) as cost_estimate",
        "if(id % 23 = 0, null, (id * 7 % 100) / 100D) as cancel_risk",
    )
    return score_patients(normalize_patients(df))


def long(df, key):
    """Report rows as {(key, metric): value}."""
    rows = [r.asDict() for r in df.collect()]
    return {
        (r[key], m): None if v is None else float(v) for r in rows for m, v in r.items() if m != key
    }


def answered(df, question_id):
    rows = df.where(F.col("question_id") == question_id).collect()
    found = {(r.key, r.metric): r.value for r in rows}
    assert len(found) == len(rows)
    return found


def same(found, expected):
    assert set(found) == set(expected)
    for k in expected:
        assert found[k] == (None if expected[k] is None else pytest.approx(expected[k])), k


def test_answers_equal_the_single_reports(ask, people):
    reports = [
        ("average wait time", R.average_wait_time(people), "specialty"),
        ("average wait time in ENT and Urology", R.average_wait_time(people, ["ENT", "Urology"]), "specialty"),
        ("average wait time in Rheumatology", R.average_wait_time(people, ["Rheumatology"]), "specialty"),
        ("specialty summary", R.specialty_analysis(people), "specialty"),
        ("ENT cost impact", R.cost_impact(people, ["ENT"]), "specialty"),
        ("high risk patients", R.high_risk_by_specialty(people), "specialty"),
        ("high risk patients 40%", R.high_risk_by_specialty(people, 40), "specialty"),
        ("high risk patients 40.0%", R.high_risk_by_specialty(people, 40), "specialty"),
        ("high risk patients 40.01%", R.high_risk_by_specialty(people, 40.01), "specialty"),
        ("high risk patients 20% ENT", R.high_risk_by_specialty(people, 20, ["ENT"]), "specialty"),
        ("high risk patients 0%", R.high_risk_by_specialty(people, 0), "specialty"),
        ("high risk patients 100%", R.high_risk_by_specialty(people, 100), "specialty"),
        ("high risk patients 500%", R.high_risk_by_specialty(people, 500), "specialty"),
        ("winter analysis", R.seasonal_analysis(people, ["Winter"]), "season"),
        ("seasonal cost", R.seasonal_analysis(people), "season"),
        ("season effect in ENT and urology",
         R.seasonal_analysis(people, None, ["ENT", "Urology"]), "season"),
        ("summer, winter analysis cardiology",
         R.seasonal_analysis(people, ["Winter", "Summer"], ["Cardiology"]), "season"),
        ("risk by segment", R.age_based_risk(people), "age_group"),
        ("risk for aged 65", R.age_based_risk(people, age=65), "age_group"),
        ("risk between 30 and 70 by age", R.age_based_risk(people, age_min=30, age_max=70), "age_group"),
        ("risk between 70 and 30 by age", R.age_based_risk(people, age_min=70, age_max=30), "age_group"),
        ("risk for elderly in ENT",
         R.age_based_risk(people, age_min=61, age_max=120, specialties=["ENT"]), "age_group"),
        ("would a senior cancel", R.age_based_cancellation(people, age_min=61, age_max=120), "age_group"),
        ("cost of children, between 0 and 999", None, None),
        ("age cost between 0 and 999", R.age_based_cost(people, age_min=0, age_max=999), "age_group"),
    ]
    answers = Q.answer_questions(ask(*[t for t, _, _ in reports]), people).cache()
    for i, (text, report, key) in enumerate(reports):
        if report is not None:
            same(answered(answers, i), long(report, key))
    answers.unpersist()


def test_what_if_answers(ask, people):
    texts = [
        "Reduce cancellations by 15%",
        "reduction of cancellations, 3 of them",
        "increase capacity by 25%",
        "baseline capacity 30, uplift 50%",
        "baseline capacity 0, increase 50%",
        "capacity for doctors",
    ]
    answers = Q.answer_questions(ask(*texts), people)
    for i, r in [(0, 15.0), (1, 20.0)]:
        whatif = R.cancellation_whatif(people, [r]).first().asDict()
        same(answered(answers, i), {("", k): float(v) for k, v in whatif.items()})
    for i, scenario in [(2, Scenario(1, 100, 25)), (3, Scenario(1, 30, 50)), (5, Scenario(1))]:
        row = capacity_answer(people, [scenario]).first().asDict()
        expected = {("", m): float(row[m]) for m in Q.CAPACITY_METRICS}
        same(answered(answers, i), expected)
    assert answered(answers, 4) == {}


def test_preview_answer_is_the_first_ten(ask, people):
    found = answered(Q.answer_questions(ask("hello"), people), 0)
    assert {k for k, _ in found} == {str(i) for i in range(1, 11)}
    assert {m for _, m in found} == set(Q.PREVIEW_METRICS)


def test_missing_question_and_missing_values(ask, people):
    none = Q.format_answers(ask(None), people).first()
    assert (none.question_type, none.report) == ("general_analysis", "preview")
    unpriced = people.withColumn("cost_estimate", F.lit(None).cast("double"))
    row = Q.format_answers(ask("specialty summary"), unpriced).first()
    assert "avg_cost=missing" in row.answer


def test_equal_requests_are_answered_once(ask, people):
    texts = ["average wait time in ENT", "ENT: mean waiting days", "high risk case 70%", "risky case"]
    requests = {r.request for r in Q.with_requests(ask(*texts)).collect()}
    assert len(requests) == 2


def test_texts(ask, people):
    texts = [
        "Reduce cancellations by 15%",
        "baseline capacity 30, uplift 50%",
        "average wait time in ENT",
        "average wait time in Rheumatology",
    ]
    rows = Q.format_answers(ask(*texts), people).orderBy("question_id").collect()
    savings = R.cancellation_whatif(people, [15.0]).first().cost_savings
    assert rows[0].answer.startswith(f"Reducing cancellations by 15.0% saves £{savings:,.2f}, frees ")
    assert "from 30 to 45 (+15) clears the backlog in 9 instead of 14 weeks (5 saved, 35.7%)" in rows[1].answer
    assert "Doctors only: +0.6 doctors for £48,000 a year." in rows[1].answer
    assert rows[2].answer.startswith("Found 1 records. ENT: avg_wait_days=")
    assert rows[3].answer == "No results found for this question."


def test_many_thresholds_close_together(spark):
    people = spark.createDataFrame(
        [(i, "ENT" if i % 3 else "Urology", 0.5 + i / 1e7, 10.0 + i) for i in range(300)]
        + [(900, "ENT", 0.5, None), (901, None, 0.9, 1.0), (902, "ENT", None, 1.0)],
        "patient_id long, specialty string, readmit_risk double, cost_estimate double",
    )
    # 100,000 thresholds, all between the risks of neighbouring patients or equal to one
    thresholds = spark.range(100_000).select((0.5 + F.col("id") / 1e10).alias("threshold"))
    found = Q.high_risk_totals(people, thresholds)
    assert found.count() == 2 * 100_000
    chosen = [0.5, 0.5 + 5 / 1e10, 0.5 + 1000 / 1e10, 0.5 + 99_999 / 1e10]
    got = {
        (r.threshold, r.specialty): r.high_risk_count
        for r in found.where(F.col("threshold").isin(chosen)).collect()
    }
    risks = [(r.specialty, r.readmit_risk) for r in people.dropna(subset=["specialty", "readmit_risk"]).collect()]
    for t in chosen:
        for who in ("ENT", "Urology"):
            assert got[t, who] == sum(s == who and risk > t for s, risk in risks)


def test_age_ranges_equal_the_reports(ask, people):
    """Ranges that cut through age groups, or lie beyond them, by two lookups each."""
    ranges = [(0, 17), (18, 18), (30, 70), (61, 200), (121, 300), (90, 20)]
    texts = [f"risk of people between {a} and {b} in ENT, by group" for a, b in ranges]
    texts += [f"By age, the cost of people between {a} and {b} in ENT and Urology" for a, b in ranges]
    rows = Q.answer_questions(ask(*texts), people).collect()
    for i, (low, high) in enumerate(ranges):
        ages = {"age_min": low, "age_max": high}
        for at, report, names, column in (
            (i, R.age_based_risk, ["ENT"], "avg_readmit_risk"),
            (i + len(ranges), R.age_based_cost, ["ENT", "Urology"], "avg_cost"),
        ):
            found = {r.key: r.value for r in rows if r.question_id == at and r.metric == column}
            expected = report(people, **ages, specialties=names).collect()
            assert found == {r.age_group: r[column] for r in expected}


def test_age_answers_take_two_lookups(ask, people):
    cells = Q.patient_cells(people)
    sums = Q.age_sums(cells).where("scope = 'ENT'").orderBy("age").collect()
    assert [r.age for r in sums] == list(range(121))
    assert sums[-1].n == people.where("specialty = 'ENT' and age between 0 and 120").count()
    assert all(a.n <= b.n for a, b in zip(sums, sums[1:]))


def test_answers_by_request(spark, people):
    """Half of all questions ask one thing; its answer is there once, with their number."""
    asked = spark.range(2000).selectExpr(
        "id as question_id",
        "if(id % 2 = 0, 'average wait time', concat('high risk case ', id % 40, '%')) as question",
    )
    rows = Q.answers_by_request(asked, people).collect()
    hot = [r for r in rows if r.report == "average_wait_time"]
    assert {r.asked for r in hot} == {1000} and len({r.request for r in hot}) == 1
    assert len(hot) == len({(r.key, r.metric) for r in hot})
    assert {r.asked for r in rows if r.report == "high_risk_patients"} == {50}
    # per question it is the same
    of = {r.question_id: r.request for r in Q.requests_of(asked).collect()}
    answers = {}
    for r in rows:
        answers.setdefault(r.request, set()).add((r.key, r.metric, r.value))
    by_question = {}
    for r in Q.answer_questions(asked, people).collect():
        by_question.setdefault(r.question_id, set()).add((r.key, r.metric, r.value))
    assert by_question == {q: answers[k] for q, k in of.items() if k in answers}


def test_a_hot_request_is_spread_over_keys(spark, people):
    """Its questions go to many tasks, without skew handling by the engine."""
    asked = spark.range(40_000).selectExpr(
        "id as question_id",
        "if(id % 2 = 0, 'average wait time', concat('high risk case ', id % 90 + 1, '%')) as question",
    )
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        answered = Q.answer_questions(asked, people)
        plan = answered._jdf.queryExecution().executedPlan().toString()
        sizes = [
            r["count"]
            for r in answered.where("report = 'average_wait_time' and metric = 'patient_count'")
            .groupBy(F.spark_partition_id()).count().collect()
        ]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "_salt" in plan and "hashpartitioning(request" in plan
    assert len(sizes) > 16 and max(sizes) < sum(sizes) / 5


def test_the_preview_size_is_a_parameter(ask, people):
    rows = Q.answer_questions(ask("hello"), people, preview_size=3).collect()
    assert len(rows) == 3 * len(Q.PREVIEW_METRICS)
    text = Q.format_answers(ask("hello"), people, preview_size=2).first().answer
    assert text.startswith("Found 2 records.")
