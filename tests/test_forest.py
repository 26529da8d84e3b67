import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from carequeue.functions.scoring import score_patients
from carequeue.operators import forest
from carequeue.operators import model as M
from carequeue.operators.normalize import normalize_patients
from carequeue.operators.shared import intermediate_tables
from carequeue.sources.grid import reference_grid

LEARNER = {"labelCol": "label", "featuresCol": "features", "seed": 5}


@pytest.fixture(scope="module")
def rows(spark):
    """A number that tells most of the label, and a name that tells some of the rest."""
    return spark.range(0, 3000, 1, 3).selectExpr(
        "cast(id * 7919 % 1009 as double) as x",
        "element_at(array('a', 'b'), cast(id * 31 % 7 % 2 + 1 as int)) as name",
        "cast(id * 7919 % 1009 + if(id * 31 % 7 % 2 = 1, 300, 0) + id % 13 * 20 > 650 as int) as label",
    ).cache()


def unpacked(stored, features):
    raw = [np.frombuffer(r.packed, np.uint8) for r in stored.collect()]
    table = np.array(raw).astype(np.int64)
    return table[:, 0], table[:, 1 : 1 + features], table[:, 1 + features :]


def gini(labels, copies):
    n = copies.sum()
    return 1 - sum((copies[labels == y].sum() / n) ** 2 for y in (0, 1))


def test_every_split_is_the_best_one(spark, rows):
    """Counts of each node and the gain of its split agree with plain sums over all rows."""
    learner = RandomForestClassifier(**LEARNER, numTrees=4, maxDepth=4)
    with intermediate_tables(spark):
        cuts = [*forest.thresholds(rows, ["x"], 32), np.array([0.5])]
        stored = forest.packed_rows(rows, learner, ["x"], [("name", ["b"])], cuts)
        trees = forest.grown_trees(stored, learner, cuts)
        label, bins, copies = unpacked(stored, 2)
    assert len(label) == rows.count() and len(cuts[0]) == 31
    assert trees.split[:, 0].all() and trees.split.sum() > 20
    for t in range(4):
        inside = {0: np.ones(len(label), bool)}
        for i in range(trees.split.shape[1]):
            if i not in inside:
                continue
            y, n = label[inside[i]], copies[inside[i], t]
            assert trees.counts[t, i].tolist() == [n[y == 0].sum(), n[y == 1].sum()]
            best = 0.0
            for f, b in ((f, b) for f in range(2) for b in range(len(cuts[f]))):
                left = bins[inside[i], f] <= b
                if n[left].sum() and n[~left].sum():
                    parts = sum(n[s].sum() * gini(y[s], n[s]) for s in (left, ~left)) / n.sum()
                    best = max(best, gini(y, n) - parts)
            if i >= 15:  # the last level
                assert not trees.split[t, i]
            elif trees.split[t, i]:
                assert trees.gain[t, i] == pytest.approx(best, abs=1e-12)
                left = bins[:, trees.feature[t, i]] <= trees.bin[t, i]
                inside[2 * i + 1], inside[2 * i + 2] = inside[i] & left, inside[i] & ~left
            else:
                assert best < 1e-12 or not trees.counts[t, i].all()


def test_bootstrap_draws(spark, rows):
    learner = RandomForestClassifier(**LEARNER, numTrees=50)
    with intermediate_tables(spark):
        stored = forest.packed_rows(rows, learner, ["x"], [], [np.array([500.0])])
        _, _, copies = unpacked(stored, 1)
    for k in range(5):
        assert (copies == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert abs(np.corrcoef(copies.T) - np.eye(50)).max() < 0.1


def test_thresholds_come_from_all_rows(spark):
    """Few values have a threshold between all of them, many have even shares of the rows."""
    df = spark.range(0, 300_000, 1, 7).selectExpr(
        "cast(id % 3 as double) as few",
        "if(id = 299999, 9D, 0D) as once",
        "pow(id * 7919 % 300007 / 300007D, 3) as many",
        "7D as same",
    )
    few, once, many, same = forest.thresholds(df, ["few", "once", "many", "same"], 32)
    assert few.tolist() == [0.5, 1.5] and once.tolist() == [4.5] and same.tolist() == []
    shares = [r[0] for r in df.selectExpr("many").collect()]
    below = np.searchsorted(np.sort(shares), many) / len(shares)
    assert below == pytest.approx(np.arange(1, 32) / 32, abs=0.002)


def test_the_model_scores_as_the_trees_say(spark, rows):
    learner = RandomForestClassifier(**LEARNER, numTrees=5, maxDepth=4)
    flagged = rows.withColumn("flag", F.expr("double(name = 'b')"))
    vectors = VectorAssembler(inputCols=["x", "flag"], outputCol="features").transform(flagged)
    fitted = forest.fit_forest(learner, rows, ["x"], [("name", ["b"])])
    assert fitted.getNumTrees == 5 and sum(fitted.featureImportances) == pytest.approx(1)
    ours = fitted.transform(vectors)
    with intermediate_tables(spark):
        cuts = [*forest.thresholds(rows, ["x"], 32), np.array([0.5])]
        stored = forest.packed_rows(rows, learner, ["x"], [("name", ["b"])], cuts)
        trees = forest.grown_trees(stored, learner, cuts)
    split = forest._merged(trees)
    for r in ours.select("x", "flag", "probability", "prediction").limit(200).collect():
        chances = []
        for t in range(5):
            i = 0
            while split[t, i]:
                f = trees.feature[t, i]
                i = 2 * i + 1 + int((r.x, r.flag)[f] > cuts[f][trees.bin[t, i]])
            chances.append(trees.counts[t, i, 1] / trees.counts[t, i].sum())
        assert r.probability[1] == pytest.approx(np.mean(chances), abs=1e-12)
    theirs = learner.fit(vectors).transform(vectors)
    chance = M.vector_to_array("probability")[1].alias("score")
    found = [M.area_under_curve(df.select("label", chance), "label") for df in (ours, theirs)]
    assert found[0] == pytest.approx(found[1], abs=0.02)


def test_rows_are_not_kept_as_objects(spark, monkeypatch):
    """A row is a byte for its label, each feature and each tree; the learner that keeps
    objects of every row is not called."""
    people = score_patients(normalize_patients(reference_grid(spark)))
    packed = []

    def kept(*args):
        packed.append(pack(*args))
        assert {len(r.packed) for r in packed[-1].collect()} == {1 + len(args[-1]) + 50}
        return packed[-1]

    def refused(*_):
        raise AssertionError("rows as objects")

    pack = forest.packed_rows
    monkeypatch.setattr(RandomForestClassifier, "_fit", refused)
    monkeypatch.setattr(forest, "packed_rows", kept)
    measured = M.evaluate(people).collect()
    assert len(packed) == 2 and len(measured) == 2


@pytest.mark.parametrize("n", [0, 40])
def test_rows_of_one_label(spark, n):
    """Nothing to tell apart: every patient's chance is 0, and no patients give no rows."""
    people = score_patients(normalize_patients(reference_grid(spark)))
    scored = M.efficiency_model(people.where("cancel_risk >= 0.05").limit(n))
    assert [tuple(r) for r in scored.select("score", "prediction").collect()] == [(0.0, 0)] * n


def test_too_many_bins(rows):
    with pytest.raises(ValueError):
        forest.fit_forest(RandomForestClassifier(**LEARNER, maxBins=64), rows, ["x"], [])
