"""Quality of documents: a text classifier shrunk with its site's record.

The classifier is a logistic model over the distinct hashed words of a text and a few of
its shapes, fitted on a bounded sample of labelled rows (``SAMPLE`` labels, smallest
hashes first). A document is good if its label says quality and not toxic.

The evidence of single documents is then combined with what is known of where they come
from, hierarchically. Sites (``source``) are shrunk toward the corpus and their sections
(``source`` and ``lang``; ``path`` where there is one) toward their site, each by a Beta
prior whose strength comes from the spread of the groups (moments), so that sparse groups
follow their parent. A section's posterior replaces the corpus prior in a document's odds,
weighed by ``SITE_WEIGHT``; documents with a posterior below ``THRESHOLD`` are rejected.

Defined cases: null and empty texts have the evidence of a text without words; null sources
and languages are groups of their own; without labels of both kinds the evidence is even
and everything is kept; an empty table gives no rows. Texts count whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carequeue.llm.batches import map_rows
from carequeue.llm.hashed_words import TO_LOWER, word_hashes
from carequeue.operators.shared import written

SAMPLE = 6000
WORD_BITS = 16
SHAPES = 8
SITE_WEIGHT = 0.5
THRESHOLD = 0.5
EPOCHS = 12
_PUNCTUATION = re.compile(rb"[^A-Za-z0-9\x80-\xff\s]")
_DROP = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())


def features(texts: Sequence[str]) -> list[tuple[list[int], list[float]]]:
    """Distinct buckets of words, punctuation off and lower case, and the text's shapes."""
    raw = [t.encode() for t in texts]
    bare = [r.translate(TO_LOWER, _DROP) for r in raw]
    hashes, bounds = word_hashes(bare)
    buckets = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    made = []
    for r, b, start, end in zip(raw, bare, bounds, bounds[1:]):
        own = np.unique(buckets[start:end])
        n, words = max(len(r), 1), max(end - start, 1)
        upper = sum(r.count(bytes([c])) for c in b"AEINORST")
        signs = len(r) - len(r.translate(None, _DROP))
        shapes = [
            min(upper / n * 5, 1.0),
            min(signs / n * 5, 1.0),
            min(sum(r.count(bytes([c])) for c in b"#*$%&|<>!") / words, 1.0),
            min(r.count(b"\n") / words * 5, 1.0),
            float(words < 5),
            float(words < 30),
            min(len(b) / words / 20, 1.0),
            len(own) / words,
        ]
        made.append((own.tolist(), shapes))
    return made


class Classifier:
    """Weights of word buckets and shapes, and the log-odds of good documents."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, bias: float, prior: float):
        self.words, self.shapes, self.bias, self.prior = words, shapes, bias, prior

    def log_odds(self, own: Sequence[int], shapes: Sequence[float]) -> float:
        at = np.asarray(own, np.int64)
        value = self.bias + self.words[at].sum() + float(np.dot(self.shapes, shapes))
        return float(np.clip(value, -12, 12))


def fit(rows: Sequence[tuple[Sequence[int], Sequence[float], int]], seed: int = 3) -> Classifier:
    """Logistic regression by AdaGrad over (buckets, shapes, good) rows."""
    words, shapes = np.zeros(1 << WORD_BITS), np.zeros(SHAPES)
    good = sum(y for *_, y in rows)
    if not 0 < good < len(rows):
        return Classifier(words, shapes, 0.0, 0.0)
    prior = float(np.log(good / (len(rows) - good)))
    bias = prior
    seen_words, seen_shapes = np.full(1 << WORD_BITS, 1e-2), np.full(SHAPES, 1e-2)
    data = [(np.asarray(o, np.int64), np.asarray(s), y) for o, s, y in rows]
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(data)):
            own, s, y = data[i]
            value = bias + words[own].sum() + shapes @ s
            p = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
            g = p - y
            if abs(g) < 0.01:
                continue
            seen_words[own] += g * g
            words[own] -= 0.1 * g / np.sqrt(seen_words[own])
            seen_shapes += (g * s) ** 2
            shapes -= 0.2 * g * s / np.sqrt(seen_shapes)
            bias -= 0.02 * g
    return Classifier(words.round(4), shapes.round(4), round(bias, 4), round(prior, 4))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled documents; only their features reach the driver."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(good).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        return features

    made = map_rows(rows, make, "own array<int>, shapes array<double>")
    found = made.dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).collect()
    return fit([(r.own, r.shapes, r.good) for r in found])


def evidence(docs: DataFrame, model: Classifier, *keep: str, keep_text: bool = False) -> DataFrame:
    """``keep`` columns and ``evidence``, the classifier's log-odds, of each document."""

    def make():
        return lambda texts: [(model.log_odds(*f),) for f in features(texts)]

    return map_rows(
        docs.select(*keep, "text"), make, "evidence double", keep_text=keep_text
    ).withColumn("evidence", F.round("evidence", 6))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(_site, _section, site_posterior, section_posterior, corpus_prior) of each section.

    Sums of good evidence per section are partial aggregates, whatever a site holds; the
    sites and the corpus are sums of those. Probabilities are summed in whole millionths,
    so that the order of rows does not matter.
    """
    chance = F.round(1_000_000 / (1 + F.exp(-F.col("evidence")))).cast("long")
    sections = written(
        scored.groupBy("_site", "_section").agg(
            F.count("*").alias("n"), F.sum(chance).alias("good")
        ),
        "quality-sections",
    )
    sites = sections.groupBy("_site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def strength(groups: DataFrame, mean: float) -> float:
        # the spread of the groups' rates beyond what sampling alone gives them
        rate = F.col("good") / 1e6 / F.col("n")
        sampling = mean * (1 - mean) / F.col("n")
        row = groups.agg(
            F.sum(F.col("n") * ((rate - mean) ** 2 - sampling)).alias("extra"),
            F.sum("n").alias("n"),
        ).first()
        between = (row.extra or 0.0) / row.n if row.n else 0.0
        return float(np.clip(mean * (1 - mean) / max(between, 1e-9) - 1, 2.0, 1e6))

    total = sections.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = float(np.clip((total.good or 0) / 1e6 / (total.n or 1), 1e-3, 1 - 1e-3))
    of_sites, of_sections = strength(sites, mean), strength(sections, mean)
    site = (F.col("good") / 1e6 + of_sites * mean) / (F.col("n") + of_sites)
    sites = sites.select("_site", F.round(site, 6).alias("site_posterior"))
    section = (F.col("good") / 1e6 + of_sections * F.col("site_posterior")) / (
        F.col("n") + of_sections
    )
    return written(
        sections.join(sites, "_site").select(
            "_site",
            "_section",
            "site_posterior",
            F.round(section, 6).alias("section_posterior"),
            F.lit(round(mean, 6)).alias("corpus_prior"),
        ),
        "quality-posteriors",
    )


def _groups(docs: DataFrame) -> dict[str, Column]:
    """Keys without nulls, and a salt that deals a hot site's rows to several tasks."""
    path = "path" if "path" in docs.columns else "lang"
    return {
        "_site": F.to_json(F.struct(F.col("source").alias("s"))),
        "_section": F.to_json(F.struct(F.col(path).alias("p"))),
        "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"),
    }


def with_posterior(scored: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Add the posteriors, ``quality`` (the combined probability) and ``kept``."""
    copies = posteriors.withColumn("_salt", F.explode(F.array(*map(F.lit, range(16)))))
    odds = F.col("evidence") + SITE_WEIGHT * (
        _logit(F.col("section_posterior")) - _logit(F.col("corpus_prior"))
    )
    return (
        scored.join(copies, ["_site", "_section", "_salt"])
        .withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 4))
        .withColumn("kept", F.col("quality") >= THRESHOLD)
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, evidence, site_posterior, section_posterior, quality, kept) of each document."""
    model = fit_on(docs, labels)
    keyed = docs.withColumns(_groups(docs))
    scored = written(evidence(keyed, model, "doc_id", "_site", "_section", "_salt"), "quality")
    return with_posterior(scored, site_posteriors(scored)).select(
        "doc_id", "evidence", "site_posterior", "section_posterior", "quality", "kept"
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, columns unchanged. Evidence is worked out twice, once for the
    posteriors and once for the documents, so that no text is stored or shuffled. A text
    goes to a worker and back once, beside the other columns of its row."""
    model = fit_on(docs, labels)
    names = [f"`{c}`" for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*names).alias("_row"), "text", *[c.alias(n) for n, c in _groups(docs).items()])
    narrow = evidence(docs.withColumns(_groups(docs)), model, "_site", "_section")
    scored = evidence(keyed, model, "_row", "_site", "_section", "_salt", keep_text=True)
    kept = with_posterior(scored, site_posteriors(narrow)).where("kept")
    return kept.select(*[F.col("text" if c == "text" else f"_row.`{c}`") for c in docs.columns])
