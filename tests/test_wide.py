"""One-hot encoding beyond the narrow bound: numbering, joins, sparse vectors, and models over them."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendscope.operators import fitted, training, wide

CONFIG = {"numeric": ["x"], "nominal": ["city", "kind"], "ordinal": {}}


def encoded(df, **more):
    params = fitted.fit_encoder(df, ["x"], ["city", "kind"], {}, **more)
    return params, fitted.apply_encoder(df, params, CONFIG, ["i"])


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    cities = [f"c{k}" for k in range(60)] + ["", "é", "Z", "\U0001f600"]
    return spark.createDataFrame(
        [(i, r.random(), "hot" if i % 3 == 0 else r.choice([None, *cities]), r.choice("ab")) for i in range(900)], "i int, x double, city string, kind string")


def test_vectors_hold_what_the_columns_hold(spark, rows):
    """The same values through both paths, for a hot category, nulls, and code points beyond one byte."""
    narrow = encoded(rows)[1]
    names = [c for c in narrow.columns if c.startswith("categoric__city_")]
    params, sparse = encoded(rows, most=5)
    assert "categoric__kind_b" in sparse.columns and "categoric__city" in sparse.columns
    got = {r.i: list(r.v) for r in sparse.select("i", vector_to_array("categoric__city").alias("v")).collect()}
    want = {r.i: list(r[1:]) for r in narrow.select("i", *names).collect()}
    assert len(names) == 64 and got == want
    assert fitted.apply_encoder(rows.limit(0), params, CONFIG, ["i"]).count() == 0


def test_unknown_category_has_no_slot(spark, rows):
    params, _ = encoded(rows, most=5)
    new = spark.createDataFrame([(1, 0.5, "nowhere", "a"), (2, None, None, "zz")], rows.schema)
    got = {r.i: r.s for r in fitted.apply_encoder(new, params, CONFIG, ["i"]).select("i", wide.filled_slots("categoric__city").alias("s")).collect()}
    assert got[1]["indices"] == [] and got[1]["size"] == 64 and len(got[2]["indices"]) == 1


@pytest.mark.parametrize("count", [10_001, 300_000])
def test_many_categories(spark, count):
    df = spark.range(count, numPartitions=4).select(
        F.col("id").cast("int").alias("i"), F.lit(1.0).alias("x"), F.format_string("k%07d", "id").alias("city"), F.lit("a").alias("kind"))
    _, coded = encoded(df)
    slots = coded.select("i", wide.filled_slots("categoric__city").alias("s"))
    row = slots.agg(F.count("*").alias("n"), F.max("s.size").alias("size"), F.sum(F.get("s.indices", F.lit(0))).alias("sum"),
                    F.count_if((F.size("s.indices") > 0) != (F.col("i") > 0)).alias("bad"),
                    F.count_if(F.get("s.indices", F.lit(0)) != F.col("i") - 1).alias("off")).first()
    assert tuple(row) == (count, count - 1, (count - 1) * (count - 2) // 2, 0, 0)


def test_numbering_starts_anew_for_each_name(spark):
    counts = spark.createDataFrame([(n, f"k{k:03d}", k + 1) for n, size in (("a", 70), ("b", 1), ("c", 33)) for k in range(size)], "name string, key string, n long")
    placed = wide.number_categories(counts.repartition(7))
    assert sorted(map(tuple, placed.select("name", "place", "key", "size").collect())) == sorted(
        (n, k, f"k{k:03d}", size) for n, size in (("a", 70), ("b", 1), ("c", 33)) for k in range(size))


def test_hot_category_does_not_meet_the_large_table(spark, rows):
    """The hot value is found by the broadcast; the join with the rest is keyed by more than the value."""
    categories = fitted.category_counts(rows, ["city"]).select("key", "n", F.lit(1).alias("place"))
    joined = wide.join_places(rows, F.col("city"), categories, 900, "p")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_spread" in plan and joined.columns == [*rows.columns, "p"]
    assert joined.where("p is null").count() == rows.where("city is null").count()


def test_narrow_path_is_unchanged(spark, rows):
    params, coded = encoded(rows)
    assert not params.where("step like 'wide%'").count() and "categoric__city" not in coded.columns


def test_a_model_learns_from_the_vector(spark, rows):
    labelled = rows.withColumn("event", (F.coalesce("city", F.lit("")) == "hot").cast("int"))
    coded = encoded(rows, most=5)[1].join(labelled.select("i", "event"), "i")
    names = training.feature_columns(coded, "event", ["i"])
    spec = {"type": "decision_tree", "name": "t", "params": {"max_depth": 3}}
    fit = training.train_model(spec, coded, coded, "event", names)
    top = training.importances(fit, spark).first()
    assert top["feature"].startswith("categoric__city[") and fit.summary.first()["roc_auc"] > 0.99
