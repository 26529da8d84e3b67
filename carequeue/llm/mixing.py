"""Mixing sources to target weights by capped water-filling.

Every source has a weight and the mix as many words as the corpus. A source is given its
share of the words by weight, but never more than ``max_epochs`` times what it has: such
sources are clamped and the excess is shared again among the others by weight, until no
source is above its limit. A document is then taken whole times (the rate of its source,
rounded down) and, for the fractional rest, once more if it comes early enough in a seeded
order of its source, so that the words taken meet the target to within a document.

Defined cases: a null text has 0 words; a null source is a source of its own, last in
order; documents without words take part with 0; an empty table gives an empty result.
Rows that agree in id and text are drawn together: all of them or none get the extra copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carequeue.operators.rank import rank_rows
from carequeue.operators.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
_HASH_BITS = 48
_BUCKET_BITS = 12
_SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """48 bits that depend on the seed, the id and the text alone."""
    key = F.concat(
        F.lit(f"{seed}:"),
        F.coalesce(doc_id.cast("string"), F.lit("-")),
        F.lit(":"),
        F.coalesce(text, F.lit("")),
    )
    return F.conv(F.substring(F.md5(key), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _draw_columns(seed: str) -> dict[str, Column]:
    text = F.col("text")
    return {
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
        "_size": word_count(text),
        "_hash": seeded_hash(F.col("doc_id"), text, seed),
    }


def _bucket() -> Column:
    return F.shiftright("_hash", _HASH_BITS - _BUCKET_BITS)


@dataclass(frozen=True)
class Mix:
    """``plan`` has a row for each source; ``draws`` the narrow row of each document."""

    plan: DataFrame
    draws: DataFrame
    seed: str


def water_fill(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Add ``weight`` and ``target`` to rows of (source, source_size).

    Each round is one aggregate over the sources that gives the driver two sums: the
    words left for the sources not clamped and their weight. The level only rises, so a
    source once clamped stays so and the last level tells which ones are.
    """
    ranked = rank_rows(sources, F.col("source").asc_nulls_last(), position="_position")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = written(
        ranked.select(
            "source",
            "source_size",
            F.element_at(
                cycle, ((F.col("_position") - 1) % len(weights) + 1).cast("int")
            ).alias("weight"),
        ),
        "mix-sources",
    )
    limit = F.col("source_size").cast("decimal(38,0)") * max_epochs
    total = weighted.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0]
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > limit.cast("double")
        row = weighted.agg(
            F.count(F.when(above, 1)).alias("clamped"),
            F.sum(F.when(above, limit)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if row.clamped == clamped or not row.weight:
            break
        clamped = row.clamped
        level = float(int(total or 0) - int(row.fixed or 0)) / row.weight
    return weighted.withColumn(
        "target", F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> Mix:
    """What each source gives: target, whole repetitions and where the extra ones end.

    Texts are read once, into narrow rows (id, source, words, hash) that are written.
    Sums per source and hash bucket have one row per bucket, whatever the source holds;
    they show in which bucket the words of the fractional repetition are reached, and
    only that bucket's documents are put in order.
    """
    draws = written(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
        .withColumns(_draw_columns(seed))
        .select("doc_id", "source", "_id", "_size", "_hash"),
        "mix-draws",
    )
    sums = written(
        draws.groupBy("source", _bucket().alias("_bucket")).agg(F.sum("_size").alias("_words")),
        "mix-buckets",
    )
    sources = sums.groupBy("source").agg(F.sum("_words").alias("source_size"))
    size = F.col("source_size")
    plan = (
        water_fill(sources, weights, max_epochs)
        .withColumn(
            "_whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
        )
        .withColumn("_extra", F.col("target") - F.col("_whole") * size)
    )
    plan = written(plan, "mix-plan")

    earlier = (
        Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = sums.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    p, b = plan.alias("p"), before.alias("b")
    last = written(
        p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")))
        .where("_before <= _extra and _extra < _before + _words")
        .select("p.source", "_extra", "_bucket", "_before"),
        "mix-last-bucket",
    )
    d, t = draws.withColumn("_in", _bucket()).alias("d"), last.alias("t")
    same = F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("_in") == F.col("_bucket"))
    key = ["_hash", "_id", "_size"]
    ties = (
        d.join(t, same)
        .groupBy("t.source", "_extra", "_bucket", "_before", *key)
        .agg(F.sum("_size").alias("_group"))
    )
    order = (
        Window.partitionBy("source").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.col("_before") + F.coalesce(F.sum("_group").over(order), F.lit(0))
    cuts = (
        ties.withColumn("_middle", 2 * reached + F.col("_group"))
        .groupBy("source", "_bucket")
        .agg(F.max(F.when(F.col("_middle") <= 2 * F.col("_extra"), F.struct(*key))).alias("_cut"))
    )
    c = cuts.select(F.col("source").alias("_of"), "_bucket", "_cut").alias("c")
    plan = plan.alias("p").join(c, F.col("p.source").eqNullSafe(F.col("c._of")), "left")
    return Mix(
        written(plan.select("p.*", "_bucket", "_cut"), "mix-cuts"), draws, seed
    )


def _with_repeats(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Join rows that have the draw columns with their source's plan; adds ``_repeats``.

    A hot source is salted: each of its rows meets one of 16 copies of the plan's row.
    """
    salted = plan.withColumn("_salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    left = rows.withColumn("_salt", F.pmod(F.col("_hash"), F.lit(_SALTS)).cast("int")).alias("l")
    right = salted.alias("r")
    on = F.col(f"l.{source}").eqNullSafe(F.col("r.source")) & (
        F.col("l._salt") == F.col("r._salt")
    )
    at = _bucket()
    # a source at its limit takes no extra words, and so no extra copies without words
    extra = (F.col("_extra") > 0) & (
        (at < F.col("_bucket"))
        | (
            (at == F.col("_bucket"))
            & F.coalesce(F.struct("_hash", "_id", "_size") <= F.col("_cut"), F.lit(False))
        )
    )
    return left.join(right, on).withColumn(
        "_repeats", F.col("_whole") + F.when(extra, 1).otherwise(0)
    )


def mix_report(mix: Mix) -> DataFrame:
    """One row per document: its words, its source's words and target, the words taken."""
    return _with_repeats(mix.draws, mix.plan, "source").select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.col("_repeats")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, columns unchanged."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source").cast("string").alias("_source"),
        "doc_id",
        "text",
    ).withColumns(_draw_columns(mix.seed))
    taken = _with_repeats(rows.select("_row", "_source", "_id", "_size", "_hash"), mix.plan, "_source")
    return (
        taken.where("_repeats > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_repeats").cast("int"))))
        .select("_row.*")
    )
