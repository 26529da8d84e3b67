import random

import pytest
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V
from carequeue.operators import infix, lookup
from carequeue.operators.lookup import (
    glossary,
    lookup_terms,
    lookup_terms_in,
    suggest_from,
    suggest_questions,
    suggestions,
)


def test_terms(spark):
    cases = [
        ("urology", "urology"),
        (" ENT ", "ent"),
        ("Gynecology", "gynecology"),
        ("neuro", "neurology"),
        ("surgery", "orthopedics"),  # the title of an earlier entry
        ("my diabetes and stroke", "diabetes"),
        ("mellitus", "diabetes"),
        ("patient", "ent"),  # contains the term
        ("", None),
        ("   ", None),
        (None, None),
        ("xyz", None),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, search string")
    rows = lookup_terms(df).orderBy("i").collect()
    assert [r.term for r in rows] == [term for _, term in cases]
    assert rows[0].url == "https://en.wikipedia.org/wiki/Urology" and rows[0].summary


def test_every_term_finds_itself(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in V.MEDICAL_TERMS], "search string")
    assert lookup_terms(df).where("term <> search or title is null").count() == 0


@pytest.mark.parametrize(
    "typed", ["co", "WAIT", "cancel", "x", "", "average cost", V.SUGGESTIONS[0], "reduce", "zzz"]
)
def test_suggestions(spark, typed):
    expected = [
        s for s in V.SUGGESTIONS if typed.lower() in s.lower() and typed.lower() != s.lower()
    ][:5] if len(typed) >= 2 else []
    df = spark.createDataFrame([(typed,)], "typed string")
    rows = suggest_questions(df).orderBy("rank").collect()
    assert [(r.rank, r.suggestion) for r in rows] == list(enumerate(expected, 1))


def plain_lookup(text, terms):
    """First by position: the exact term, else any overlap; terms are (position, term, title)."""
    wanted = (text or "").lower().strip(" ")
    if not wanted:
        return None
    exact = [p for p, term, _ in terms if term == wanted]
    partly = [
        p for p, term, title in terms
        if term and (wanted in term or term in wanted or wanted in title.lower())
    ]
    return min(exact, default=min(partly, default=None))


def word(rng, n):
    return "".join(rng.choice("abcdefgh") for _ in range(n))


def test_table_glossary_equals_the_literal_one(spark):
    searches = ["urology", " ENT ", "neuro", "surgery", "my diabetes and stroke", "mellitus",
                "patient", "", "   ", None, "xyz", "en", "e", "(ent", "\U0001f600", "a" * 500]
    df = spark.createDataFrame(list(enumerate(searches)), "search_id long, search string")
    expected = {r.search_id: r.term for r in lookup_terms(df).collect()}
    found = lookup_terms_in(df, glossary(spark))
    assert found.columns == ["search_id", "search", "position", "term", "title", "summary", "url"]
    assert {r.search_id: r.term for r in found.collect()} == expected


@pytest.mark.parametrize("at_once", [lookup.TERMS_AT_ONCE, 70])
def test_table_glossary_equals_brute_force(spark, monkeypatch, at_once):
    """Short and long texts, several passes, joins that shuffle."""
    if at_once == 70:
        monkeypatch.setattr(lookup, "TERMS_AT_ONCE", 70)
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(infix, "FIRST_BLOCK", 16)
    rng = random.Random(5)
    terms = [(10 + i, word(rng, rng.randrange(1, 9)), word(rng, 12).title()) for i in range(200)]
    terms += [(1, "", "blank"), (900, "abc\U0001f600d", "Emoji"), (901, terms[0][1], "again")]
    texts = [word(rng, rng.randrange(0, 7)) for _ in range(300)]
    texts += [" ".join(word(rng, 5) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [t for _, t, _ in terms[:20]] + [t[2:9] for _, _, t in terms[:20]]
    texts += ["\U0001f600", "c\U0001f600d", None, "zzz", texts[5]] + ["hot"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "search_id long, search string")
    table = spark.createDataFrame(terms, "position long, term string, title string")
    rows = lookup_terms_in(df, table).collect()
    assert len(rows) == len(texts)
    of_position = {p: (term, title) for p, term, title in terms}
    for r in rows:
        assert r.position == plain_lookup(r.search, terms), r.search
        assert (r.term, r.title) == of_position.get(r.position, (None, None))


def test_a_glossary_of_a_hundred_thousand_terms(spark):
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 9)))
                    for _ in range(101_000)})[:100_000]
    rng.shuffle(terms)
    rows = [(i, t, f"Title {t}") for i, t in enumerate(terms)]
    texts = [" ".join(rng.sample(terms, 3)) for _ in range(12)] + terms[:8]
    texts += [t[1:] for t in terms[30:38]] + ["".join(rng.sample("abcdefghijklmnop", 9)) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "search_id long, search string")
    table = spark.createDataFrame(rows, "position long, term string, title string")
    for r in lookup_terms_in(df, table).collect():
        assert r.position == plain_lookup(r.search, rows), r.search


def test_terms_of_an_empty_glossary(spark):
    df = spark.createDataFrame([(1, "abc")], "search_id long, search string")
    row = lookup_terms_in(df, glossary(spark).limit(0)).first()
    assert (row.search, row.position, row.term) == ("abc", None, None)
    assert lookup_terms_in(df.limit(0), glossary(spark)).count() == 0


@pytest.mark.parametrize("first_block", [infix.FIRST_BLOCK, 8])
def test_table_of_suggestions_equals_brute_force(spark, monkeypatch, first_block):
    monkeypatch.setattr(infix, "FIRST_BLOCK", first_block)
    rng = random.Random(7)
    offered = [word(rng, rng.randrange(1, 14)).title() for _ in range(400)] + ["ab", "AB", "abc"]
    rng.shuffle(offered)
    typed = [word(rng, rng.randrange(0, 6)) for _ in range(400)] + offered[:40]
    typed += [o[1:] for o in offered[40:80]] + [None, "a" * 300, "ab", "AB"] + ["ab"] * 30
    df = spark.createDataFrame(list(enumerate(typed)), "question_id long, typed string")
    table = spark.createDataFrame([(3 * i + 5, s) for i, s in enumerate(offered)], "position long, suggestion string")
    found = {}
    for r in suggest_from(df, table, shown_at_most=3).orderBy("rank").collect():
        found.setdefault(r.question_id, []).append((r["rank"], r.suggestion))
    for i, t in enumerate(typed):
        fitting = [s for s in offered if t and len(t) >= 2 and t.lower() in s.lower() and t.lower() != s.lower()]
        assert found.get(i, []) == list(enumerate(fitting[:3], 1)), t


def test_table_of_suggestions_equals_the_literal_one(spark):
    typed = ["co", "WAIT", "cancel", "x", "", "average cost", V.SUGGESTIONS[0], "reduce", "zzz", "what is the"]
    df = spark.createDataFrame(list(enumerate(typed)), "question_id long, typed string")
    assert sorted(suggest_from(df, suggestions(spark)).collect()) == sorted(suggest_questions(df).collect())


def test_suggestions_are_not_in_the_plan(spark):
    df = spark.range(5).select(F.col("id").alias("question_id"), F.lit("cost").alias("typed"))
    plan = suggest_from(df, suggestions(spark))._jdf.queryExecution().executedPlan().toString()
    assert V.SUGGESTIONS[3] not in plan
