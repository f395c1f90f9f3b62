"""The registered model queries do their whole job."""

import inspect

import pytest
from pyspark.sql import functions as F

from lendscope.operators import training
from lendscope.plans import loans as L
from lendscope.plans import model_queries


@pytest.fixture
def tables(spark, monkeypatch):
    rows = spark.range(120).select(
        F.col("id").alias(L.KEY), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias(L.EVENT))
    found = {"train": rows.where("loan_id < 90"), "test": rows.where("loan_id >= 90"), "features": ["a"]}
    monkeypatch.setattr(model_queries, "matrices", lambda *_: found)


class Caught(Exception):
    pass


def arguments(monkeypatch, spark, operator, query):
    """What ``query`` gives to ``operator``, with the operator's defaults."""
    takes, seen = inspect.signature(getattr(training, operator)), []

    def catch(*args, **kwargs):
        bound = takes.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)
        raise Caught

    monkeypatch.setattr(training, operator, catch)
    with pytest.raises(Caught):
        query(spark, "")
    return seen[0]


def test_the_record_compares_all_model_types(spark, tables, monkeypatch):
    given = arguments(monkeypatch, spark, "train_catalogue", model_queries.model_record)
    assert {s["type"] for s in given["specs"]} == set(training.KNOWN_PARAMS) and len(given["specs"]) == 5
    assert given["k"] == 5 and given["train"].count() == 90 and given["test"].count() == 30


def test_the_learning_curve_repeats_thirty_times(spark, tables, monkeypatch):
    given = arguments(monkeypatch, spark, "learning_curve", model_queries.learning_curve_tree)
    assert given["repeats"] == 30 and given["sizes"] == (0.1, 0.325, 0.55, 0.775, 1.0) and given["test_size"] == 0.2
    assert given["train"].count() == 90
