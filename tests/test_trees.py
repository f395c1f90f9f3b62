"""Trees of many fits grown together against Spark's own trees, fitted one by one."""

import numpy as np
import pytest
from pyspark import StorageLevel

from lendscope.operators import training, trees

TREE = {"type": "decision_tree", "name": "T", "params": {"max_depth": 4, "min_samples_leaf": 5, "class_weight": "balanced"}}
FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    n = 700
    a, b = r.normal(size=n), np.round(r.normal(size=n) * 20) / 4  # more values than bins, many of them shared
    c, d = (r.random(n) < 0.3).astype(float), r.integers(-2, 3, n).astype(float)
    y = (r.random(n) < 1 / (1 + np.exp(2 - 1.5 * a + b / 3 - 2 * c * d))).astype(int)
    return spark.createDataFrame(
        [(i, *map(float, v), 4.0, int(e)) for i, (*v, e) in enumerate(zip(a, b, c, d, y))],
        "i long, a double, b double, c double, d double, e double, y int").repartition(3).persist()


def curve(rows, spec=TREE, repeats=2, sizes=(0.3, 1.0), metric="f1", features=FEATURES):
    found = training.learning_curve(spec, rows, "y", features, "i", repeats, sizes, metric=metric)
    return sorted(tuple(r) for r in found.drop("fit_time_mean", "fit_time_std").collect())


@pytest.mark.parametrize("params", [{}, {"max_depth": 2, "min_samples_leaf": 60}, {"class_weight": None, "max_depth": None}])
def test_trees_equal_those_of_spark(rows, monkeypatch, params):
    spec = {**TREE, "params": {**TREE["params"], **params}}
    together = curve(rows, spec)
    monkeypatch.setattr(training, "_tree_slots", lambda *_: 0)
    alone = curve(rows, spec)
    assert together == [pytest.approx(r, abs=1e-12) for r in alone] and together[1][1] > 0.3


def test_nodes_and_rows_in_small_groups(rows, monkeypatch):
    whole = curve(rows)
    monkeypatch.setattr(trees, "MOST_CELLS", 1)
    monkeypatch.setattr(trees, "FOLD_ROWS", 7)
    monkeypatch.setattr(trees, "HELD_BYTES", 500)
    assert curve(rows) == whole


def test_rows_are_not_kept_in_memory_and_not_fitted_one_by_one(rows, monkeypatch):
    """What a fit keeps must not grow with the rows, and the scans not with the fits."""
    kept, kind = [], type(rows)
    persist = kind.persist

    def note(df, level=StorageLevel.MEMORY_AND_DISK_DESER):
        kept.append(level)
        return persist(df, level)

    monkeypatch.setattr(kind, "persist", note)
    monkeypatch.setattr(training, "fit_assembled", lambda *_: pytest.fail("fitted alone"))
    assert len(curve(rows, repeats=3)) == 2
    assert kept and not any(level.useMemory for level in kept)


def test_other_labels_and_constant_features(spark, rows):
    flat = spark.range(80).selectExpr("id AS i", "1D AS a", "cast(id % 4 = 0 AS int) AS y")
    found = curve(flat, {**TREE, "params": {"max_depth": 3}}, features=["a"], metric="accuracy")
    assert all(0.5 < r[3] <= 1 for r in found)  # no cut: every row counts as no event
    counts, plain = trees.part_counts(spark.sql("SELECT 2 AS y, array(1, 0) AS parts UNION ALL SELECT 1, array(0, 2)"), "y", 2)
    assert not plain and counts[0, 0, 1] == counts[1, 2, 1] == counts.sum() / 2 == 1
