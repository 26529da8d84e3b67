"""Staffing-efficiency classifier on pyspark.ml.

The label is a rule over columns that are also features, so high scores say little about
unseen practice; ``evaluate`` reports rows held out by id next to the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.functions.scoring import spread, to_percent, with_efficiency_label
from carequeue.operators.forest import fit_forest
from carequeue.operators.normalize import to_number
from carequeue.operators.rank import running_sums
from carequeue.operators.shared import at_the_same_time, new_path, written

NUMERIC = ["age", "los", "cost_estimate", "cancel_risk", "priority_score"]
STAFFING = ["patients_per_doctor", "patients_per_nurse", "total_staff_efficiency"]
CATEGORIES = ["gender", "specialty", "season"]
LABEL = "efficiency_label"
PARTS_PER_CORE = 4
ROWS_PER_FILE = 1_000_000
NO_VALUE = "(none)"  # category of a missing value; sorts before any name


def _indexer(columns: Sequence[str]) -> StringIndexer:
    # descending, so that the encoder drops the alphabetically first value
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}_index" for c in columns],
        stringOrderType="alphabetDesc",
        handleInvalid="keep",
    )


def training_rows(df: DataFrame) -> DataFrame:
    """Scored patients with the label and filled copies of the features.

    A ratio missing in every row fills up as a constant 0, which no model can use.
    """
    labelled = with_efficiency_label(df)
    numbers = {
        _feature(c): F.coalesce(to_number(F.col(c)), F.lit(0.0)) for c in [*NUMERIC, *STAFFING]
    }
    names = {
        _feature(c): F.coalesce(F.col(c), F.lit(NO_VALUE)) for c in CATEGORIES if c in df.columns
    }
    return labelled.withColumns({**numbers, **names})


def stored_rows(df: DataFrame) -> DataFrame:
    """Training rows written once in even parts, as fitting reads them several times.

    The rows that a forest reads at every level lie in parts like these, so a part more
    than there are cores, or one that is larger than others, is waited for each time. The
    parts are ``PARTS_PER_CORE`` for each core, dealt by id, and their files alike, so that
    tasks get as many of them each. Rows that are alike lie together and take the same ways
    through the trees; the order is total, as the rows that a tree draws depend on it.
    """
    rows = training_rows(df)
    parts = PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    alike = [LABEL, *map(_feature, ["cancel_risk", *STAFFING]), "patient_id"]
    path = new_path(df.sparkSession, "training")
    dealt = rows.repartition(parts, "patient_id").sortWithinPartitions(*alike)
    dealt.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _feature(column: str) -> str:
    return f"feature_{column}"


def onehot_features(df: DataFrame, columns: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
    """One 0/1 column per value and label column, without the first value of each.

    A missing value has 0 everywhere.
    """
    rows = df.select("patient_id", *columns)
    indexer = _indexer(columns).fit(rows)
    indexed = [f"{c}_index" for c in columns]
    encoder = OneHotEncoder(
        inputCols=indexed, outputCols=[f"{c}_vector" for c in columns], dropLast=False
    )
    encoded = encoder.fit(indexer.transform(rows)).transform(indexer.transform(rows))
    dummies = []
    for column, values in zip(columns, indexer.labelsArray):
        flags = vector_to_array(F.col(f"{column}_vector"))
        named = {value: flags[i].cast("int") for i, value in enumerate(values)}
        dummies += [named[v].alias(f"{column}_{v}") for v in sorted(values)[1:]]
    return encoded.select("patient_id", *dummies)


def train(
    rows: DataFrame, model: str = "forest", numeric_only: bool = False, seed: int = 42
) -> PipelineModel:
    """Fit on ``training_rows``. ``numeric_only`` leaves the label columns out.

    A label column with the same value in every row says nothing and is left out too.
    """
    stages, inputs = [], [_feature(c) for c in [*NUMERIC, *STAFFING]]
    named = [_feature(c) for c in CATEGORIES if _feature(c) in rows.columns]
    present = []
    if named and not numeric_only:
        varied = rows.agg(*[(F.min(c) != F.max(c)).alias(c) for c in named]).first()
        present = [c for c in named if varied[c]]
    if present:
        encoded = [f"{c}_vector" for c in present]
        stages = [
            _indexer(present).setHandleInvalid("error"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in present], outputCols=encoded),
        ]
        inputs = [*inputs, *encoded]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    if model == "forest":
        learner = RandomForestClassifier(
            labelCol=LABEL, featuresCol="features", numTrees=50, maxDepth=10, seed=seed
        )
        prepared = Pipeline(stages=[*stages, assembler]).fit(rows)
        # a flag for each value but the last, which is alphabetically the first
        labels = prepared.stages[0].labelsArray if present else []
        flags = [(c, list(values)[:-1]) for c, values in zip(present, labels, strict=True)]
        numeric = [_feature(c) for c in [*NUMERIC, *STAFFING]]
        return PipelineModel([*prepared.stages, fit_forest(learner, rows, numeric, flags)])
    elif model == "logistic":
        learner = LogisticRegression(labelCol=LABEL, featuresCol="features", maxIter=1000)
    else:
        raise ValueError(f"unknown model: {model}")
    return Pipeline(stages=[*stages, assembler, learner]).fit(rows)


def score(rows: DataFrame, fitted: PipelineModel) -> DataFrame:
    """Add the prediction, the probability of an efficient operation and its percentage."""
    predicted = fitted.transform(rows).withColumns(
        {
            "score": vector_to_array("probability")[1],
            "prediction": F.col("prediction").cast("int"),
        }
    )
    kept = [c for c in rows.columns if not c.startswith("feature_")]
    return predicted.select(*kept, "prediction", "score", to_percent(F.col("score")).alias("percentage"))


def efficiency_model(df: DataFrame, model: str = "forest", numeric_only: bool = False) -> DataFrame:
    """Scored patients with the classifier's columns, trained on the same rows."""
    rows = stored_rows(df)
    return score(rows, train(rows, model, numeric_only))


def feature_importance(rows: DataFrame, fitted: PipelineModel, top: int = 5) -> DataFrame:
    """Features by importance. The result has one row per feature, not per patient."""
    importances = fitted.stages[-1].featureImportances
    attributes = fitted.transform(rows).schema["features"].metadata["ml_attr"]["attrs"]
    names = {
        a["idx"]: a["name"].removeprefix("feature_").replace("_vector_", "_")
        for kind in attributes.values()
        for a in kind
    }
    ranked = [(names[i], float(importances[i])) for i in range(len(names))]
    return (
        rows.sparkSession.createDataFrame(ranked, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def area_under_curve(scored: DataFrame, label: str = LABEL, score: str = "score") -> float | None:
    """The chance that a row of label 1 scores above one of label 0, ties counting half.

    Exact, from the ranks of the scores and not from points of a curve. Rows of a score
    are counted first, and the zeros below each score are running sums over range-sorted
    scores; all numbers are whole until the last division. None if a label is missing.
    """
    ones, zeros = F.col(label) == 1, F.col(label) == 0
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(ones).alias("ones"), F.count_if(zeros).alias("zeros")
    )
    ranked = running_sums(
        counts.withColumn("all", F.lit(True)), F.col("score"), sums={"up_to": "zeros"}, by="all"
    )
    # half the zeros of the score itself and all those below it, twice
    wide = "decimal(38,0)"
    beaten = F.col("ones").cast(wide) * (2 * F.col("up_to") - F.col("zeros")).cast(wide)
    row = ranked.agg(
        F.sum(beaten).alias("beaten"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")
    ).first()
    if not row.ones or not row.zeros:
        return None
    return int(row.beaten) / (2 * row.ones * row.zeros)


def evaluate(df: DataFrame, model: str = "forest", numeric_only: bool = False) -> DataFrame:
    """AUC and accuracy on the training rows, and on a fifth of rows held out by id.

    Samples are scored once, into written rows that both measures read. The two models are
    fitted side by side, as each waits for its driver between levels.
    """
    rows = stored_rows(df)
    held = spread("patient_id", 5) == 0
    learned, unseen = rows.where(~held), rows.where(held)

    right = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")

    def measured(name: str, learned: DataFrame, sample: DataFrame) -> tuple[str, float, float]:
        fitted = train(learned, model, numeric_only)
        scores = written(
            fitted.transform(sample).select(
                LABEL, "prediction", vector_to_array("probability")[1].alias("score")
            ),
            "scores",
        )
        return name, area_under_curve(scores), right.evaluate(scores)

    return df.sparkSession.createDataFrame(
        at_the_same_time(
            lambda: measured("training rows", rows, rows),
            lambda: measured("held out", learned, unseen),
        ),
        "sample string, auc double, accuracy double",
    )
