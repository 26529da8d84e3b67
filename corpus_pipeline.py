"""A corpus prepared for training, in five stages over ``documents``.

1. quality: documents the classifier rejects go,
2. near duplicates: of each group (five-word shingles, similarity 0.8) one stays,
3. personal data: spans are replaced by their kind; ``n_chars`` follows the text,
4. mixing: sources are taken to their target weights, documents repeated accordingly,
5. encoding: token ids of every document of the mix.

Each stage takes (spark, docs, folder of tables) and works on all the one before kept. All
but the last return the columns of ``documents``. Between stages rows are written as
Parquet to the shared folder and read again, so that a lost executor repeats one stage at
most. Classifier and personal data model are fitted on bounded samples (parameters of
their operators); everything else covers all rows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm import mixing, near_duplicates, personal_data, quality, sentencepiece_spans
from carequeue.llm.registry import PIECE_MODEL, tokenizer_path
from carequeue.operators.shared import written
from carequeue.sources.tables import load_table


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.good_documents(docs, load_table(spark, folder, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    redacted = personal_data.redacted_documents(docs)
    if "n_chars" not in docs.columns:
        return redacted
    n = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.mix_plan(docs))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    columns = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return sentencepiece_spans.document_ids(docs, tokenizer_path(PIECE_MODEL), *columns)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact),
    ("mixing", mix),
    ("encoding", encode),
]

#: Fitted models and tokenizers have no SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
