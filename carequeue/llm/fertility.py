"""Quality rules from tokenizer fertility, with bands for each language.

A public vocabulary is run over every text. Junk does not fit a vocabulary: it takes more
tokens for its characters, falls back to bytes or repeats few tokens. Three figures are
taken per document: characters per token, the share of tokens that are bytes, and the
entropy of its tokens. For each language and size class of documents the corpus gives
the quartiles of each figure, and a document is rejected where one lies beyond the
quartiles by more than ``WIDTH`` times their distance (with a floor on the distance).
Documents that fail the base rules set no bands.

Every document has a band, however small the table. The quartiles of a class are means of
its own and its parent's, by the weights n (its documents) and ``PRIOR``. The parent of a
class is the class with its neighbours on both sides, merged until they hold ``MIN_NEAR``
documents or the whole language; the parent of that is the language and of this the corpus.
So a class of equal documents that is far from the rest of its language may be rejected as
a whole. Quartiles are exact over values rounded to ``STEPS``, whose number does not depend
on the number of documents.

Defined cases: null texts have no words and fail the base rules; a null language is a
language of its own; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.llm.batches import map_rows
from carequeue.llm.hashed_words import word_hashes
from carequeue.llm.sentencepiece_spans import encoder_of
from carequeue.operators.shared import written

MIN_WORDS = 50
# the least, in quarters, that loses 0.5% of good labelled documents with even ids at most
WIDTH = 2.5
MIN_NEAR = 100
PRIOR = 25
# smallest distance between quartiles that a band is built on
FLOORS = {"chars_per_token": 0.15, "byte_share": 0.005, "token_entropy": 0.15}
# values are rounded to these steps before quartiles are taken
STEPS = {"chars_per_token": 0.01, "byte_share": 0.0005, "token_entropy": 0.01}
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(hashes) < 4:
        return 0
    a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
    windows = (a * np.uint64(3) + (b ^ (b >> np.uint64(7)))) * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(5)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    found = counts[inverse] > 1
    covered = np.zeros(len(hashes), bool)
    for shift in range(3):
        covered[shift : shift + len(found)] |= found
    return int(covered.sum())


def base_figures(text: str, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(hashes),
        len(text) - spaces,
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(hashes),
    )


def token_figures(ids: list[int], byte_ids: np.ndarray, chars: int) -> tuple:
    """Characters per token, share of byte tokens, entropy of the tokens in bits."""
    if not ids:
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    seen = counts[counts > 0] / len(ids)
    spelled = int(counts[byte_ids[byte_ids < len(counts)]].sum())
    entropy = float(-(seen * np.log2(seen)).sum())
    return len(ids), chars / len(ids), spelled / len(ids), entropy


def figures(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document with the figures of the base rules and of its tokens."""

    def make():
        encoder = encoder_of(model_path)
        byte_ids = np.array(sorted(encoder.byte_of), dtype=np.int64)

        def work(texts):
            hashes, bounds = word_hashes([t.encode() for t in texts])
            rows = []
            for text, a, b in zip(texts, bounds, bounds[1:]):
                ids = encoder.encode(text)
                rows.append(
                    (*base_figures(text, hashes[a:b]), *token_figures(ids, byte_ids, len(text)))
                )
            return rows

        return work

    return map_rows(
        docs.select("doc_id", "lang", "text"),
        make,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " n_tokens long, chars_per_token double, byte_share double, token_entropy double",
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _steps(usable: DataFrame) -> DataFrame:
    """Documents per language, size class, figure and step of its value."""
    values = [
        F.struct(F.lit(c).alias("_figure"), (F.round(F.col(c) / step) * step).alias("_at"))
        for c, step in STEPS.items()
    ]
    return (
        usable.select("_lang", "_class", F.explode(F.array(*values)).alias("_v"))
        .groupBy("_lang", "_class", "_v._figure", "_v._at")
        .agg(F.count("*").alias("_n"))
    )


def _quartiles(steps: DataFrame, to: str, *keys: str) -> DataFrame:
    found = F.struct(
        F.sum("_n").alias("n"), F.percentile("_at", [0.25, 0.75], F.col("_n")).alias("q")
    )
    return steps.groupBy(*keys, "_figure").agg(found.alias(to))


def _near(steps: DataFrame) -> DataFrame:
    """(_lang, _class, _other): each class with those whose documents are merged with it."""
    cells = (
        steps.where(F.col("_figure") == next(iter(STEPS)))
        .groupBy("_lang", "_class")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_lang")
        .agg(F.collect_list(F.struct("_class", "_n")).alias("_cells"), F.sum("_n").alias("_all"))
    )

    def within(reach):
        return F.filter("_cells", lambda c: F.abs(c["_class"] - F.col("_class")) <= reach)

    def held(reach):
        return F.aggregate(within(reach), F.lit(0).cast("long"), lambda n, c: n + c["_n"])

    enough = F.least(F.lit(MIN_NEAR), F.col("_all"))
    reach = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda r: held(r) >= enough))
    return (
        cells.select("*", F.explode(F.transform("_cells", lambda c: c["_class"])).alias("_class"))
        .withColumn("_reach", reach)
        .select("_lang", "_class", F.explode(within(F.col("_reach"))["_class"]).alias("_other"))
    )


def _shrunk(own: Column, parent: Column) -> Column:
    """Quartiles of a group, drawn to those of its parent."""
    return F.zip_with(
        own["q"], parent, lambda a, b: (own["n"] * a + PRIOR * b) / (own["n"] + PRIOR)
    )


def _bands(steps: DataFrame) -> DataFrame:
    """One row per language and size class, with a column of quartiles for each figure."""
    merged = _near(steps).join(
        steps.withColumnRenamed("_class", "_other"), ["_lang", "_other"]
    )
    band = _shrunk(F.col("_language"), F.col("_corpus.q"))
    for level in ("_merged", "_own"):
        band = _shrunk(F.col(level), band)
    return (
        _quartiles(steps, "_own", "_lang", "_class")
        .join(_quartiles(merged, "_merged", "_lang", "_class"), ["_lang", "_class", "_figure"])
        .join(_quartiles(steps, "_language", "_lang"), ["_lang", "_figure"])
        .join(_quartiles(steps, "_corpus"), "_figure")
        .groupBy("_lang", "_class")
        .agg(*[F.max(F.when(F.col("_figure") == c, band)).alias(f"_q_{c}") for c in FLOORS])
    )


def _beyond(value: str) -> Column:
    """How many quartile distances a value lies beyond its quartiles; 0 or less inside."""
    low, high = F.col(f"_q_{value}")[0], F.col(f"_q_{value}")[1]
    distance = F.greatest(high - low, F.lit(FLOORS[value]))
    return F.greatest(low - F.col(value), F.col(value) - high) / distance


def measured(docs: DataFrame, model_path: str) -> DataFrame:
    """Figures of every document and ``beyond``, the most that one lies beyond its band (null
    where the base rules fail and nothing else of the class sets one). Texts are read once;
    the bands come from counts per step of a value, however many documents a language has."""
    rows = written(
        figures(docs, model_path).withColumns(
            {
                "_lang": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")),
                "_class": F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))),
            }
        ),
        "fertility",
    )
    steps = written(_steps(rows.where(~F.col("base_failed"))), "fertility-steps")
    bands = _bands(steps)
    return (
        rows.join(bands, ["_lang", "_class"], "left")
        .withColumn("beyond", F.greatest(*[_beyond(c) for c in FLOORS]))
        .drop("_lang", "_class", "lang", *[f"_q_{c}" for c in FLOORS])
    )


def quality_rules(docs: DataFrame, model_path: str) -> DataFrame:
    """Figures of every document and ``kept``."""
    kept = ~F.col("base_failed") & (F.col("beyond") <= WIDTH)
    return measured(docs, model_path).withColumn("kept", F.coalesce(kept, F.lit(False))).drop("beyond")
