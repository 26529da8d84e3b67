"""Type, parameters and report of a question as expressions over its text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from carequeue.functions import fixed_values as V

CAPACITY_TYPES = ["cancellation_reduction", "capacity_analysis", "capacity_staffing"]
SEASONAL_TYPES = [
    "seasonal_analysis",
    "seasonal_readmission",
    "seasonal_cost",
    "seasonal_comparison",
]
OWN_REPORT_TYPES = [
    "average_wait_time",
    "specialty_analysis",
    "high_risk_patients",
    "cost_impact",
    "age_based_risk",
    "age_based_cancellation",
    "age_based_cost",
]


# Lines end at \n only, for the dot as for the beginning of a line.
_LINES = "(?md)"


def _least(words: list[str]) -> list[str]:
    """Words of which none contains another: where a longer one occurs, so does a shorter."""
    return [w for w in words if not any(other != w and other in w for other in words)]


def _ways(pattern: str) -> list[list[list[str]]]:
    """For each way to match, the lists of words that follow each other on a line; a
    number is a list of one digit."""
    ways = []
    for sequence in pattern.split(")|("):
        lists = sequence.removeprefix("(").removesuffix(")").split(").*(")
        ways.append([[r"\d"] if r"\d" in part else _least(part.split("|")) for part in lists])
    return ways


def one_pass(pattern: str) -> str:
    """A pattern of word lists that follow each other on a line, to be read once.

    From the beginning of a line the first word of the first list is looked for, after it
    the first of the next, and so on; none is given up for a later one. The first to begin
    is the first to end, as no word contains another, so that it leaves most of the line
    to the rest: where it does not lead to a match, no later one does. The time then grows
    with the text and not with its third power.
    """
    ways = ["".join(f"(?>.*?(?:{'|'.join(words)}))" for words in way) for way in _ways(pattern)]
    return f"{_LINES}^(?:{'|'.join(ways)})"


def has_words(text: Column, pattern: str) -> Column:
    """Whether a text holds, anywhere, a word of each list of a way of the pattern.

    No other text can match. Plain words are found much faster than by an expression, and
    a list without one settles its way, so that few texts are left to be matched.
    """

    def holds(word: str) -> Column:
        # a dot stands for any character: what is around it is looked for
        return reduce(and_, [F.contains(text, F.lit(part)) for part in word.split(".")])

    def every(way: list[list[str]]) -> Column:
        return reduce(and_, [reduce(or_, map(holds, w)) for w in way if w != [r"\d"]])

    return reduce(or_, map(every, _ways(pattern)))


def question_type(lowered: str) -> Column:
    """First type whose pattern occurs in the lower-cased text."""
    text = F.col(lowered)
    return F.coalesce(
        *[
            F.when(has_words(text, p) & text.rlike(one_pass(p)), F.lit(name))
            for name, p in V.QUESTION_PATTERNS
        ],
        F.lit(V.DEFAULT_QUESTION_TYPE),
    )


def _number_after(words: str, number: str) -> str:
    """The first words on a line that a number follows there, without trying later ones."""
    return f"{_LINES}^(?>.*?{words}).*?{number}"


# The patterns of parameters in forms that read a text once. Spaces between the words of a
# capacity may go over the end of a line, which can only be so for its last such words.
_BASELINE = (
    rf"{_LINES}^(?:(?>.*?baseline[^\S\n]+capacity)|.*baseline[^\S\n]*\n\s*+capacity).*?(\d+)"
)
_RISK_WEIGHT = _number_after(*V.RISK_WEIGHT_PATTERN.split(".*?"))
_THRESHOLD = _number_after(*V.THRESHOLD_PATTERN.split(".*?"))
_PERCENT = r"(?<!\d)(\d++(?:\.\d++)?)%"


def _group(text: str, pattern: str, type_name: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).try_cast(type_name)


def _mentions(lowered: str, name: str) -> str:
    """SQL test for a name; single words must stand alone. The cheap test comes first."""
    phrase = f"contains({lowered}, '{name}')"
    if " " in name:
        return phrase
    return rf"{phrase} and {lowered} rlike r'\b{re.escape(name)}\b'"


def _word(lowered: str, words: str) -> str:
    """SQL test for words standing alone, one or more."""
    return rf"contains({lowered}, '{words}') and {lowered} rlike r'\b{re.escape(words)}\b'"


def _found(names: list[str], lowered: str, test: Callable[[str, str], str]) -> Column:
    """Names for which the test holds, in list order; NULL if there are none."""
    flags = ", ".join(f"if({test(lowered, n.lower())}, '{n}', null)" for n in names)
    return F.expr(f"nullif(array_compact(array({flags})), array())")


def question_parameters(text: str, lowered: str) -> dict[str, Column]:
    """Parameter columns of a question except the age range; NULL if not mentioned.

    ``lowered`` names a column with the lower-cased text, so that it is lowered once.
    """
    numbers = F.regexp_extract_all(text, F.lit(V.NUMBER_PATTERN), 1)
    # a stated capacity that is no 64-bit number stays missing
    baseline = F.when(
        F.col(lowered).rlike(_BASELINE), _group(lowered, _BASELINE, "bigint")
    ).when(
        F.expr(f"contains({lowered}, 'capacity') or contains({lowered}, 'increase')"),
        F.lit(V.DEFAULT_BASELINE).cast("bigint"),
    )
    # the last word of the list that occurs
    words = " ".join(f"when {_word(lowered, w)} then '{w}'" for w, _, _ in reversed(V.AGE_WORDS))
    return {
        "percentage": _group(text, _PERCENT, "double"),
        "numbers": F.when(F.size(numbers) > 0, numbers).try_cast("array<double>"),
        "baseline_capacity": baseline,
        "risk_weight": _group(lowered, _RISK_WEIGHT, "double"),
        "threshold": _group(lowered, _THRESHOLD, "double"),
        "specialties": _found(V.QUESTION_SPECIALTIES, lowered, _mentions),
        "seasons": _found(V.SEASONS, lowered, _word),
        "age": _group(lowered, V.AGE_PATTERN, "int"),
        "age_group": F.expr(f"case {words} end"),
    }


def age_range(lowered: str) -> dict[str, Column]:
    """Ages of the age word if there is one, else those of a stated range."""

    def bound(group: int) -> Column:
        ages = " ".join(f"when '{row[0]}' then {row[group]}" for row in V.AGE_WORDS)
        return F.coalesce(
            F.expr(f"case age_group {ages} end"),
            _group(lowered, V.AGE_RANGE_PATTERN, "int", group),
        )

    return {"age_min": bound(1), "age_max": bound(2)}


def question_report(kind: Column, lowered: str) -> Column:
    """Report that answers a question of this type; the preview where there is none."""
    text = F.col(lowered)
    what_if = (
        F.when(F.contains(text, F.lit("cancel")), "cancellation_whatif")
        .when(
            F.contains(text, F.lit("capacity")) | F.contains(text, F.lit("increase")),
            "capacity_answer",
        )
        .otherwise("preview")
    )
    return (
        F.when(kind.isin(CAPACITY_TYPES), what_if)
        .when(kind.isin(SEASONAL_TYPES), "seasonal_analysis")
        .when(kind.isin(OWN_REPORT_TYPES), kind)
        .otherwise("preview")
    )
