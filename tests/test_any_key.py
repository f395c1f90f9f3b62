"""Splits, folds and positions for keys of any type; unreadable dates; curves with NaN; model parameters."""

import math

import pytest
from pyspark.sql import functions as F

from lendscope.operators import monitoring, running, splits, training
from lendscope.operators.features import date_features
from lendscope.operators.metrics import score_counts


@pytest.mark.parametrize("key", ["if(id % 2 = 0, null, id)", "concat('k', id)", "id + 4611686018427387904L", "cast(null as string)", "id % 5"])
def test_split_and_fold_sizes_are_exact(spark, key):
    df = spark.range(1000).selectExpr(f"{key} AS key", "id", "cast(id % 10 = 0 as int) AS event")
    train, test = splits.stratified_split(df, "key", "event")
    assert (train.count(), test.count(), test.where("event = 1").count()) == (800, 200, 20)
    sizes = {r["fold"]: r["count"] for r in splits.folds(df, "key", 3, ["event"]).groupBy("fold").count().collect()}
    assert sorted(sizes) == [0, 1, 2] and sum(sizes.values()) == 1000 and max(sizes.values()) - min(sizes.values()) <= 2


@pytest.mark.parametrize("key", ["id + 4611686018427387904L", "lpad(id, 5, '0')", "timestamp_seconds(id)", "if(id = 0, null, id)"])
def test_position_quarters_of_any_key(spark, key):
    for n, want in ((10, [3, 2, 2, 3]), (1, [1]), (2, [1, 1])):
        df = spark.range(n).selectExpr(f"{key} AS key").repartition(3)
        got = {r["window"]: r["count"] for r in monitoring.position_quarters(df, "key").groupBy("window").count().collect()}
        assert sum(got.values()) == n and (n != 10 or [got[q] for q in sorted(got)] == want)


def test_unreadable_dates_become_null(spark):
    df = spark.createDataFrame([(1, "2025-01-31 10:00:00"), (2, "bad"), (3, None), (4, "2025-03-01")], "id int, d string")
    got = date_features(df, "d", {"reference_date": "2025-04-01"}).collect()
    assert [r["month"] for r in got] == [1, None, None, 3]
    train, test = splits.temporal_split(df, "d", "2025-01")
    assert [r.id for r in train.collect()] == [1] and [r.id for r in test.collect()] == [4]


def test_both_ways_of_running_totals_agree(spark):
    df = spark.createDataFrame([(float("nan") if i % 7 == 0 else None if i % 11 == 0 else (i % 13) / 4, i % 3 == 0) for i in range(200)], "s double, a boolean")
    counts = score_counts(df.withColumn("a", F.col("a").cast("int")), "s", "a")
    collected = lambda d: sorted(tuple(r) for r in d.select("score", "pos", "neg", "cum_pos", "cum_neg").collect())
    small, large = (collected(running.running_totals(counts, "score", ["pos", "neg"], window_rows=w)) for w in (1000, 3))
    assert small == large and not any(math.isnan(r[0]) for r in small)
    raw = df.selectExpr("s AS score", "cast(a as long) AS pos", "1L AS neg").groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    assert [collected(running.running_totals(raw, "score", ["pos", "neg"], window_rows=w)) for w in (1000, 3)][0] == \
        collected(running.running_totals(raw, "score", ["pos", "neg"], window_rows=3))


@pytest.mark.parametrize("kind,extra", [("decision_tree", {}), ("random_forest", {"n_estimators": 5}), ("gradient_boosting", {"n_estimators": 4}),
                                        ("hist_gradient_boosting", {"max_iter": 4}), ("logistic_regression", {"max_iter": 20})])
def test_every_model_type_fits_and_refuses_unknown_parameters(spark, kind, extra):
    df = spark.range(300).selectExpr("cast(id % 10 AS double) AS x", "cast(id % 7 AS double) AS y", "cast(id % 10 > 6 AS int) AS event")
    model = training.fit_classifier({"type": kind, "params": extra}, df, "event", ["x", "y"])
    scored = training.add_probability(model, df, ["x", "y"])
    low, high = (scored.where(f"event = {e}").agg(F.avg("score")).first()[0] for e in (0, 1))
    assert high > low + 0.2
    with pytest.raises(ValueError, match="ccp_alpha"):
        training.make_estimator({"type": kind, "params": {"ccp_alpha": 0.1}}, "event", 1.0)


def test_defaults_follow_the_type():
    depth = lambda kind, **p: training.make_estimator({"type": kind, "params": p}, "event", 1.0).getMaxDepth()
    assert depth("gradient_boosting") == 3 and depth("decision_tree") == 30 and depth("gradient_boosting", max_depth=None) == 30
    assert training.make_estimator({"type": "hist_gradient_boosting"}, "event", 1.0).min_samples_leaf == 20
