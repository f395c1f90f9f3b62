import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendscope.operators import features, fitted
from lendscope.sources import sinks


def values(df, name, key="i"):
    return [r[name] for r in df.orderBy(key).select(name).collect()]


@pytest.fixture(scope="module")
def income(spark):
    rows = [(0, "EMP", 2e6), (1, "EMP", 3e6), (2, "IND", 1.5e6), (3, "PEN", None), (4, "EMP", None)]
    return spark.createDataFrame(rows, "i int, work string, income double")


def test_segment_medians(spark, income):
    params = fitted.fit_segment_medians(income, {"income": "work", "absent": "work"})
    new = spark.createDataFrame(
        [(0, "EMP", None), (1, "PEN", None), (2, "NEW", None), (3, None, None), (4, "IND", 9.0)],
        "i int, work string, income double")
    got = fitted.apply_segment_medians(new, params, {"income": "work"})
    assert values(got, "income") == [2.5e6, 2e6, 2e6, 2e6, 9.0]
    assert values(income, "income")[3] is None


def test_caps_cut_only_above(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)] + [(101, None)], "i int, x double")
    df = df.withColumn("empty", F.lit(None).cast("double"))
    params = fitted.fit_caps(df, ["x", "empty", "absent"], 0.99)
    assert params.count() == 1 and params.first()["value"] == pytest.approx(99.01)
    got = values(fitted.apply_caps(df, params), "x")
    assert got[:99] == [float(i) for i in range(1, 100)] and got[99] == pytest.approx(99.01) and got[100] is None


def test_cap_of_an_imputed_column_uses_imputed_values(spark):
    df = spark.createDataFrame([(i, "a", float(i) if i <= 50 else None) for i in range(1, 101)], "i int, g string, x double")
    params = fitted.fit_base(df, {"impute": {"x": "g"}, "cap_columns": ["x"], "cap_quantile": 0.9})
    filled = np.array([i if i <= 50 else 25.5 for i in range(1, 101)], dtype=float)
    cap = params.where("step = 'cap'").first()["value"]
    assert cap == pytest.approx(np.quantile(filled, 0.9))


def test_encoder(spark):
    train = spark.createDataFrame(
        [(0, 1.0, 5.0, "b", "lo"), (1, 3.0, 5.0, "a", "hi"), (2, None, 5.0, "a", None), (3, 8.0, 5.0, None, "hi")],
        "i int, x double, flat double, c string, o string")
    order = {"o": ["lo", "hi"]}
    params = fitted.fit_encoder(train, ["x", "flat"], ["c"], order)
    config = {"numeric": ["x", "flat"], "nominal": ["c"], "ordinal": order}
    got = fitted.apply_encoder(train, params, config, ["i"])
    assert got.columns == ["i", "numeric__x", "numeric__flat", "categoric__c_b", "cat_ord__o"]
    filled = np.array([1.0, 3.0, 3.0, 8.0])
    assert np.allclose(values(got, "numeric__x"), (filled - filled.mean()) / filled.std())
    assert values(got, "numeric__flat") == [0.0] * 4
    assert values(got, "categoric__c_b") == [1.0, 0.0, 0.0, 0.0]
    assert values(got, "cat_ord__o") == [0.0, 1.0, 1.0, 1.0]
    new = spark.createDataFrame([(0, None, 6.0, "zz", "odd")], train.schema)
    row = fitted.apply_encoder(new, params, config).first()
    assert row["numeric__flat"] == 1.0 and row["categoric__c_b"] == 0.0 and row["cat_ord__o"] == -1.0


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "i int, c string")
    params = fitted.fit_encoder(df, [], ["c"], {})
    assert params.where("step = 'mode'").first()["key"] == "a"


CONFIG = {
    "date_col": "d",
    "split": {"type": "temporal", "date_col": "d", "train_cutoff": "2024-06"},
    "derived": {"ratios": [{"name": "r", "numerator": "x", "denominator": "y"}]},
    "catalogues": {"t": ["up", "down"]},
    "impute": {"y": "g"}, "cap_columns": ["x"], "cap_quantile": 0.9,
    "leakage": ["leak"], "drop": ["junk"],
    "numeric": ["x", "y", "r"], "nominal": ["g"], "ordinal": {"t": ["down", "up"]},
}


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(0)
    n = 400
    return pd.DataFrame({
        "i": np.arange(n), "d": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 360, n), unit="D"),
        "x": rng.gamma(2, 100, n), "y": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 5, n)),
        "g": rng.choice(["a", "b", "c"], n), "t": rng.choice(["up", "down", "bad"], n),
        "leak": 1.0, "junk": 2.0, "event": rng.integers(0, 2, n),
    })


def test_build_features_matches_pandas(spark, raw, tmp_path):
    df = spark.createDataFrame(raw)
    df = df.withColumn("d", F.col("d").cast("timestamp_ntz")).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    parts = fitted.build_features(df, CONFIG, "event", ["i"])

    ratio = raw["x"] / raw["y"].replace(0, np.nan)
    is_train = raw["d"] < "2024-07-01"
    train = raw[is_train]
    y = raw["y"].fillna(raw["g"].map(train.groupby("g")["y"].median())).fillna(train["y"].median())
    x = raw["x"].clip(upper=train["x"].quantile(0.9))
    filled = ratio.fillna(ratio[is_train].median())
    for name, col in (("x", x), ("y", y), ("r", filled)):
        z = (col - col[is_train].mean()) / col[is_train].std(ddof=0)
        got = parts["test"].orderBy("i").toPandas()
        assert np.allclose(got[f"numeric__{name}"], z[~is_train], atol=1e-9), name
    assert parts["train"].count() == is_train.sum()
    assert "leak" not in parts["train_base"].columns and "junk" not in parts["train_base"].columns

    again = fitted.apply_fitted(df.where(F.col("d") >= "2024-07-01"), parts["params"], CONFIG, ["i", "event"])
    a, b = again.orderBy("i").toPandas(), parts["test"].orderBy("i").toPandas()
    assert np.allclose(a[b.columns].to_numpy(float), b.to_numpy(float))

    folder = str(tmp_path / "features")
    with pytest.raises(FileNotFoundError, match="train_base"):
        sinks.read_features(spark, folder)
    sinks.write_features(parts, folder)
    cached = sinks.read_features(spark, folder)
    assert cached["params"].count() == parts["params"].count()
    reapplied = fitted.apply_fitted(df, cached["params"], CONFIG, ["i"])
    assert reapplied.count() == 400


def test_combined_variant_keeps_drop_columns(spark, raw):
    df = spark.createDataFrame(raw).withColumn("d", F.col("d").cast("timestamp_ntz"))
    base, _ = fitted.fit_combined(df, CONFIG)
    assert "junk" in base.columns and "leak" not in base.columns and "d" not in base.columns


def test_missing_feature_is_reported(spark, raw):
    df = spark.createDataFrame(raw)
    with pytest.raises(ValueError, match="nope"):
        fitted.fit_encoder(df, ["nope"], [], {})
    assert features.drop_columns(df, ["absent", "x"]).columns == [c for c in df.columns if c != "x"]
