"""Quantiles, running totals and splits against numpy and brute force, with one value in a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendscope.operators import quantiles, splits
from lendscope.operators.quantiles import collected_quantiles, even_probs, exact_quantiles
from lendscope.operators.running import running_totals
from lendscope.sources.readers import nan_to_null
from lendscope.sources.workspace import settle_local


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=n)
    x[: n // 3] = 0.25
    x[5::50] = np.nan
    return pd.DataFrame({
        "id": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abcd"), n)),
        "x": x, "k": rng.integers(0, 9, n),
    })


@pytest.fixture(scope="module")
def skewed_df(spark, skewed):
    return nan_to_null(spark.createDataFrame(skewed)).repartition(4).cache()


@pytest.mark.parametrize("window_rows", [2_000_000, 40])
def test_quantiles_match_numpy(skewed, skewed_df, window_rows):
    probs = even_probs(10)
    got = {r["name"]: r for r in exact_quantiles(skewed_df, ["x", "k"], probs, window_rows=window_rows).collect()}
    for c in ("x", "k"):
        clean = skewed[c].dropna()
        assert got[c]["n"] == len(clean)
        assert np.allclose(got[c]["quantiles"], np.quantile(clean, probs), rtol=0, atol=1e-12)
        ranks = np.floor(np.array(probs) * (len(clean) - 1)).astype(int)
        assert list(got[c]["lower"]) == list(np.sort(clean.to_numpy(dtype=float))[ranks])


def test_grouped_quantiles_match_pandas(skewed, skewed_df):
    got = exact_quantiles(skewed_df, ["x"], [0.25, 0.5, 0.75], ["g"]).collect()
    want = skewed.groupby("g")["x"].quantile([0.25, 0.5, 0.75])
    assert len(got) == 5
    for r in got:
        assert np.allclose(r["quantiles"], want[r["g"]].to_numpy(), atol=1e-12)


def test_many_groups_take_the_joined_path(monkeypatch, skewed, skewed_df):
    """Beyond the broadcast bound the brackets are checkpointed and joined; results stay the same."""
    monkeypatch.setattr(quantiles, "settle_local", lambda d: settle_local(d, rows=2))
    got = exact_quantiles(skewed_df, ["x", "k"], [0.5, 0.99], ["g"]).collect()
    assert len(got) == 10
    for r in got:
        want = skewed[skewed["g"] == r["g"]][r["name"]].quantile([0.5, 0.99])
        assert np.allclose(r["quantiles"], want.to_numpy(), atol=1e-12)


def test_quantiles_of_tiny_and_empty_input(spark):
    df = spark.createDataFrame([(7.0,), (None,)], "x double")
    assert collected_quantiles(df, ["x"], [0.0, 0.5, 1.0]) == {"x": [7.0, 7.0, 7.0]}
    assert collected_quantiles(df.where("x > 9"), ["x"], [0.5]) == {}


def test_null_group_is_kept_apart(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    got = {r["g"]: r["quantiles"][0] for r in exact_quantiles(df, ["x"], [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranged_running_totals_equal_one_window(skewed_df, by, descending):
    counts = skewed_df.where("x is not null").groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    plain = running_totals(counts, "x", ["c"], by, descending, levels=10**6)
    ranged = running_totals(counts, "x", ["c"], by, descending, window_rows=100)
    rows = lambda d: sorted(tuple(r) for r in d.select(*by, "x", "c", "cum_c", "total_c").collect())
    assert rows(plain) == rows(ranged)
    assert ranged.columns == plain.columns and ranged.count() == counts.count()


def test_temporal_split_boundaries(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2025-09-30 23:59:59'), (2, TIMESTAMP_NTZ'2025-10-01 00:00:00'),
                      (3, CAST(NULL AS TIMESTAMP_NTZ)) AS t(id, d)""")
    train, test = splits.temporal_split(df, "d", "2025-09")
    assert [r["id"] for r in train.collect()] == [1] and [r["id"] for r in test.collect()] == [2]


def test_unknown_split_type(spark):
    with pytest.raises(ValueError):
        splits.split_frame(spark.range(1), {"type": "other"}, "e")


def test_folds_are_disjoint_complete_and_even(skewed_df):
    got = splits.folds(skewed_df, "id", 7, ["g"])
    assert got.count() == 6000 and got.select("id").distinct().count() == 6000
    sizes = got.groupBy("g", "fold").count().toPandas().groupby("g")["count"]
    assert (sizes.max() - sizes.min() <= 1).all() and (sizes.count() == 7).all()


def test_colliding_hashes_are_ranked_exactly(spark):
    # Keys with equal hash share one value, so every cut falls among them.
    p = 1_000_003
    keys = [(i * p * p,) for i in range(10)] + [(i,) for i in range(5)]
    df = spark.createDataFrame(keys, "id long")
    got = splits.folds(df, "id", 4).groupBy("fold").count().toPandas().sort_values("fold")["count"].tolist()
    assert got == [4, 4, 4, 3]


def test_stratified_split_sizes_and_seed(skewed_df):
    train, test = splits.stratified_split(skewed_df, "id", "g", 0.2)
    want = skewed_df.groupBy("g").count().toPandas().set_index("g")["count"] * 0.2
    got = test.groupBy("g").count().toPandas().set_index("g")["count"]
    assert (abs(got - want) <= 0.5).all() and train.count() + test.count() == 6000
    other = splits.stratified_split(skewed_df, "id", "g", 0.2, seed=1)[1]
    again = splits.stratified_split(skewed_df, "id", "g", 0.2)[1]
    ids = lambda d: {r["id"] for r in d.select("id").collect()}
    assert ids(test) == ids(again) != ids(other)


def test_repeated_shuffles_nest(skewed_df):
    got = splits.repeated_shuffles(skewed_df.select("id"), "id", 2, [0.1, 0.5, 1.0])
    sizes = got.groupBy("repeat", "part").count().orderBy("repeat", "part").toPandas()["count"].tolist()
    assert sizes == [1200, 480, 1920, 2400] * 2
