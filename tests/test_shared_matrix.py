"""Cross-validation and learning curves over one assembled matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import splits, training
from lendscope.operators.metrics import pick_threshold, score_curve

LOGISTIC = {"type": "logistic_regression", "name": "L", "params": {"C": 1.0, "max_iter": 60, "class_weight": "balanced"}}
TREE = {"type": "decision_tree", "name": "T", "params": {"max_depth": 3, "min_samples_leaf": 5}}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(500, 2))
    y = (r.random(500) < 1 / (1 + np.exp(1.2 - 1.5 * x[:, 0] + x[:, 1]))).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(e)) for i, ((a, b), e) in enumerate(zip(x, y))], "i long, a double, b double, y int").repartition(3)


def test_folds_equal_fits_of_their_own(rows):
    """Each fold is fitted, calibrated and measured as if it were the only one."""
    got = {r["fold"]: r for r in training.cross_validate(LOGISTIC, rows, "y", ["a", "b"], "i", 3, "recall", 0.2).collect()}
    tagged = splits.folds(rows, "i", 3, ["y"]).persist()
    for fold in range(3):
        model = training.fit_classifier(LOGISTIC, tagged.where(F.col("fold") != fold), "y", ["a", "b"])
        scored = training.add_probability(model, tagged, ["a", "b"])
        cut = pick_threshold(score_curve(scored.where(F.col("fold") != fold), "score", "y"), "recall", 0.2).first()[0]
        held = scored.where(F.col("fold") == fold).withColumn("pred", (F.col("score") >= cut).cast("int"))
        hit = held.agg(F.count_if((F.col("pred") == 1) & (F.col("y") == 1)) / F.count_if(F.col("y") == 1)).first()[0]
        assert got[fold]["recall"] == pytest.approx(hit, abs=1e-9) and got[fold]["roc_auc"] > 0.7
    tagged.unpersist()


def test_one_matrix_for_all_models(rows):
    matrix = training.fold_matrix(rows, "y", ["a", "b"], "i", 4, partitions=2)
    assert matrix.classes() == training.class_counts(rows, "y") and sum(matrix.classes(0)) == 375
    alone = training.cross_validate(TREE, rows, "y", ["a", "b"], "i", matrix=matrix, at_once=1)
    side = training.cross_validate(TREE, rows, "y", ["a", "b"], "i", matrix=matrix, at_once=4)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, side.collect()))
    matrix.release()
    found = training.train_catalogue([LOGISTIC, TREE], rows, rows, "y", ["a", "b"], "i", 3)
    assert set(found["fitted"]) == {"L", "T"} and found["cv"].count() == 10


@pytest.mark.parametrize("metric", ["recall", "accuracy"])
def test_learning_curve_over_parts(rows, metric):
    curve = {r["size"]: r for r in training.learning_curve(TREE, rows, "y", ["a", "b"], "i", 2, (0.2, 1.0), metric=metric).collect()}
    parts = splits.shuffle_parts(rows, "i", 2, (0.2, 1.0))
    want = []
    for r in range(2):
        used = parts.withColumn("part", F.get("parts", F.lit(r)))
        model = training.fit_classifier(TREE, used.where("part > 0"), "y", ["a", "b"])
        held = training.add_probability(model, used.where("part = 0"), ["a", "b"]).withColumn("p", (F.col("score") >= 0.5).cast("int"))
        of = F.count_if(F.col("p") == F.col("y")) / F.count("*") if metric == "accuracy" else F.sum(F.col("p") * F.col("y")) / F.sum("y")
        want.append(held.agg(of).first()[0])
    assert curve[2]["test_mean"] == pytest.approx(np.mean(want), abs=1e-9) and curve[1]["train_mean"] >= 0
    with pytest.raises(ValueError, match="unknown metric"):
        training.learning_curve(TREE, rows, "y", ["a", "b"], "i", metric="gain")


def test_a_part_without_events_counts_zero(spark):
    rows = spark.range(60).selectExpr("id AS i", "cast(id AS double) AS a", "cast(id = 3 AS int) AS y")
    curve = training.learning_curve(TREE, rows, "y", ["a"], "i", 2, (0.05, 1.0)).collect()
    assert len(curve) == 2 and all(0 <= r["train_mean"] <= 1 for r in curve)
