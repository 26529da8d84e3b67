"""Glossary lookup and question suggestions for whole columns of typed text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V
from carequeue.operators.infix import containing
from carequeue.operators.shared import written

SUGGESTIONS_SHOWN = 5
#: Terms that are sent to the tasks at once; a larger glossary takes several passes.
TERMS_AT_ONCE = 500_000
#: Rows of a table that is sent to all tasks; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000
SALTS = 32


def _glossary() -> str:
    entries = ", ".join(
        f"named_struct('term', '{term}', 'title', '{title}', 'lowered', '{title.lower()}',"
        f" 'summary', '{V.MEDICAL_SUMMARIES[title]}', 'url', '{V.ENCYCLOPEDIA}{page}')"
        for term, title, page in V.MEDICAL_TERMS
    )
    return f"array({entries})"


def lookup_terms(df: DataFrame, column: str = "search") -> DataFrame:
    """Add the glossary entry of each search text: exact term first, else first partial.

    The glossary is a literal of 28 entries, so rows stay where they are. Blank and
    unknown searches have no entry.
    """
    partly = "contains(e.term, _text) or contains(_text, e.term) or contains(e.lowered, _text)"
    entry = F.expr(
        f"""if(_text = '', null, coalesce(
            get(filter({_glossary()}, e -> e.term = _text), 0),
            get(filter({_glossary()}, e -> {partly}), 0)))"""
    )
    return (
        df.withColumn("_text", F.trim(F.lower(column)))
        .withColumn("_entry", entry)
        .select(*df.columns, "_entry.term", "_entry.title", "_entry.summary", "_entry.url")
    )


def glossary(spark: SparkSession) -> DataFrame:
    """The fixed glossary as a table: position, term, title, summary, url."""
    rows = [
        (i, term, title, V.MEDICAL_SUMMARIES[title], V.ENCYCLOPEDIA + page)
        for i, (term, title, page) in enumerate(V.MEDICAL_TERMS)
    ]
    return spark.createDataFrame(
        rows, "position long, term string, title string, summary string, url string"
    )


_automata: dict[str, object] = {}


def _automaton(name: str, terms: Broadcast):
    """Of the terms of a pass, built once per worker. The last one is kept."""
    import ahocorasick

    if name not in _automata:
        built = ahocorasick.Automaton()
        for term, position in terms.value:
            if position < built.get(term, position + 1):
                built.add_word(term, position)
        built.make_automaton()
        _automata.clear()
        _automata[name] = built
    return _automata[name]


def _first_inside(terms: Broadcast):
    """The least position of a term that occurs in each text; a text is read once."""
    name = uuid.uuid4().hex

    @F.pandas_udf("long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(name, terms)
        for texts in batches:
            least = [
                min((p for _, p in automaton.iter(t)), default=None) if t else None for t in texts
            ]
            yield pd.Series(least, dtype="Int64")

    return found


def _with_inside(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Add ``_inside``, the position of the first term that the lowered text contains.

    Passes over a glossary of more than ``TERMS_AT_ONCE`` terms go by position, and rows
    that found a term do not look in later ones.
    """
    spark = rows.sparkSession
    n = entries.count()
    rows = rows.withColumn("_inside", F.lit(None).cast("long"))
    for at in range(0, n, TERMS_AT_ONCE):
        part = entries.where((F.col("_rank") > at) & (F.col("_rank") <= at + TERMS_AT_ONCE))
        # no more terms than one pass has
        terms = [(r.term, r.position) for r in part.select("term", "position").collect()]
        inside = _first_inside(spark.sparkContext.broadcast(terms))
        open_text = F.when(F.col("_inside").isNull(), F.col("_text"))
        rows = rows.withColumn("_inside", F.coalesce("_inside", inside(open_text)))
    return rows


def _met(left: DataFrame, right: DataFrame, key: str, salt: str) -> DataFrame:
    """Left rows with the row of ``right`` that has their key, if any, whatever the skew.

    A small right side goes to all tasks. A large one is repeated for each salt, and left
    rows with one key are dealt out over the salts by another column.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "_salt"], "left").drop("_salt")


def lookup_terms_in(
    df: DataFrame, terms: DataFrame, column: str = "search", row_id: str = "search_id"
) -> DataFrame:
    """Add the entry of a glossary table that each text finds: position, term, title.

    ``terms`` has position (whole numbers, each once), term and title; further columns
    are added too. Of all entries the exact term comes first, then the first by position
    whose term contains the text, or is contained in it, or whose title contains the text.
    Texts are whole and as long as they are: terms inside them are found by an automaton
    that reads them once. Short texts inside terms and titles are found by an index of
    grams, each distinct text once. Blank and missing texts and terms find nothing.
    """
    from carequeue.operators.rank import rank_rows

    named = terms.where("term <> ''").withColumn("term", F.lower("term"))
    ranked = written(rank_rows(named, F.col("position").asc(), position="_rank"), "terms")
    texts = df.withColumn("_text", F.trim(F.lower(column)))
    rows = written(_with_inside(texts, ranked), "searches")

    entries = ranked.select(
        (F.col("_rank") * 2).alias("entry"), F.col("term").alias("lowered")
    ).union(ranked.select(F.col("_rank") * 2 + 1, F.lower("title")).where("title <> ''"))
    longest = entries.agg(F.max(F.char_length("lowered"))).first()[0] or 0
    short = F.char_length("_text").between(1, longest)
    distinct = written(
        rows.where(short).select(F.col("_text").alias("text")).distinct(), "short-searches"
    )
    exact = ranked.groupBy(F.col("term").alias("text")).agg(F.min("position").alias("_exact"))
    partly = containing(distinct, entries).select(
        "text", F.expr("entry div 2").alias("_rank")
    )
    partly = partly.join(ranked.select("_rank", F.col("position").alias("_partly")), "_rank")
    known = written(
        distinct.join(exact, "text", "left").join(partly.drop("_rank"), "text", "left"),
        "known-searches",
    )
    keyed = rows.withColumn("text", F.when(short, F.col("_text")))
    met = _met(keyed, known, "text", row_id)
    # the least of what there is
    position = F.coalesce("_exact", F.least("_inside", "_partly"))
    kept = [c for c in terms.columns if c != "position"]
    found = met.select(*[F.col(f"`{c}`") for c in df.columns], position.alias("position"))
    return _met(found, ranked.select("position", *kept), "position", row_id).select(
        *[F.col(f"`{c}`") for c in df.columns], "position", *kept
    )


def suggestions(spark: SparkSession) -> DataFrame:
    """The fixed suggestions as a table: position, suggestion."""
    return spark.createDataFrame(
        list(enumerate(V.SUGGESTIONS, 1)), "position long, suggestion string"
    )


def suggest_from(
    df: DataFrame,
    offered: DataFrame,
    column: str = "typed",
    shown_at_most: int = SUGGESTIONS_SHOWN,
    row_id: str = "question_id",
) -> DataFrame:
    """Up to ``shown_at_most`` suggestions of a table per typed text, one row each.

    ``offered`` has position (whole numbers, each once) and suggestion. Suggestions that
    contain the text come in order of their positions; a text of less than two letters
    and a suggestion equal to the text give none. Each distinct text is looked up once.
    """
    entries = written(offered.select("position", "suggestion"), "offered")
    rows = df.withColumn("_text", F.when(F.char_length(column) >= 2, F.lower(column)))
    distinct = rows.where("_text is not null").select(F.col("_text").alias("text")).distinct()
    found = containing(
        written(distinct, "typed"),
        entries.select(F.col("position").alias("entry"), F.lower("suggestion").alias("lowered")),
        shown_at_most,
        longer_only=True,
    )
    named = found.join(entries, F.col("entry") == F.col("position"))
    # as many in a list as are shown
    lists = named.groupBy(F.col("text").alias("_text")).agg(
        F.array_sort(F.collect_list(F.struct("entry", "suggestion"))).alias("_shown")
    )
    met = _met(rows, written(lists, "suggested"), "_text", row_id)
    shown = F.posexplode("_shown").alias("_at", "_of")
    return met.select(*df.columns, shown).select(
        *df.columns, (F.col("_at") + 1).alias("rank"), F.col("_of.suggestion").alias("suggestion")
    )


def suggest_questions(
    df: DataFrame, column: str = "typed", shown_at_most: int = SUGGESTIONS_SHOWN
) -> DataFrame:
    """Up to ``shown_at_most`` suggestions per typed text, one row each, in list order."""
    listed = ", ".join(
        f"named_struct('text', '{s}', 'lowered', '{s.lower()}')" for s in V.SUGGESTIONS
    )
    shown = F.expr(
        f"""if(length({column}) >= 2, slice(
            filter(array({listed}), s -> contains(s.lowered, _text) and s.lowered <> _text),
            1, {shown_at_most}), null)"""
    )
    return (
        df.withColumn("_text", F.lower(column))
        .select(*df.columns, F.posexplode(shown).alias("_at", "_shown"))
        .select(
            *df.columns,
            (F.col("_at") + 1).alias("rank"),
            F.col("_shown.text").alias("suggestion"),
        )
    )
