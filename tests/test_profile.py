import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendscope.operators import association, profile, splits


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 1500
    event = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=n) + event
    x[::17] = np.nan
    return pd.DataFrame({
        "event": event, "x": x, "k": rng.integers(0, 6, n).astype(float),
        "c": rng.choice(["a", "b", "z"], n), "two": np.where(rng.random(n) < 0.4 + 0.2 * event, "y", "n"),
    })


@pytest.fixture(scope="module")
def df(spark, data):
    out = spark.createDataFrame(data)
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


def test_quantile_bins_match_qcut(df, data):
    for c in ("x", "k"):
        tmp = data[[c, "event"]].dropna()
        want = tmp.groupby(pd.qcut(tmp[c], 10, duplicates="drop"), observed=True)["event"].agg(["mean", "size"])
        got = profile.rate_by_quantile(df, [c], "event").orderBy("bin").toPandas()
        assert got["n"].tolist() == want["size"].tolist()
        assert np.allclose(got["event_rate"], want["mean"])


def test_histogram_matches_numpy(df, data, spark):
    got = profile.histogram(df, ["x", "k"], 12).orderBy("name", "bin").toPandas()
    for c in ("x", "k"):
        counts, edges = np.histogram(data[c].dropna(), bins=12)
        density, _ = np.histogram(data[c].dropna(), bins=12, density=True)
        mine = got[got["name"] == c]
        assert mine["n"].tolist() == counts.tolist()
        assert np.allclose(mine["bin_lo"], edges[:-1]) and np.allclose(mine["density"], density)
    tiny = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.0, 2.0, 10.0, 10.0)], "x double")
    assert [r["n"] for r in profile.histogram(tiny, ["x"], 5).orderBy("bin").collect()] == [3, 1, 0, 0, 2]
    flat = profile.histogram(tiny.select(F.lit(4.0).alias("x")), ["x"], 4).orderBy("bin").collect()
    assert flat[0]["bin_lo"] == 3.5 and sum(r["n"] for r in flat) == 6


def test_histogram_per_class_uses_own_ranges(df, data):
    got = profile.histogram(df, ["x"], 8, ["event"]).toPandas()
    for e in (0, 1):
        counts, _ = np.histogram(data[data["event"] == e]["x"].dropna(), bins=8)
        assert got[got["event"] == e].sort_values("bin")["n"].tolist() == counts.tolist()


def test_monthly_rate_centred_mean(spark):
    rows = [(f"2024-0{m}-15 00:00:00", i < m) for m in range(1, 5) for i in range(10)] + [(None, True)]
    df = spark.createDataFrame(rows, "t string, e boolean").select(
        F.col("t").cast("timestamp_ntz").alias("d"), F.col("e").cast("int").alias("event"))
    got = profile.monthly_rate(df, "d", "event").orderBy("month").collect()
    assert [r["n"] for r in got] == [10] * 4
    assert [r["rolling3"] for r in got] == [None, pytest.approx(0.2), pytest.approx(0.3), None]


def test_weekdays_are_all_listed(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 00:00:00' AS d, 1 AS event")
    got = profile.weekday_rate(df, "d", "event").collect()
    assert [r["weekday"] for r in got][:2] == ["Monday", "Tuesday"] and len(got) == 7
    assert got[0]["n"] is None and got[1]["n"] == 1


def test_summary_box_outliers_match_pandas(df, data):
    d = data["x"].describe()
    row = profile.column_summary(df, ["x"]).first()
    assert np.allclose([row[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")], d.to_numpy())
    q1, q3 = data["x"].quantile([0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = int(((data["x"] < low) | (data["x"] > high)).sum())
    out = profile.iqr_outliers(df, ["x"]).first()
    assert out["n_outliers"] == outside and out["pct"] == pytest.approx(100 * outside / len(data))
    box = profile.box_stats(df, ["x"]).first()
    inside = data["x"][(data["x"] >= low) & (data["x"] <= high)]
    assert (box["whisker_low"], box["whisker_high"], box["n_beyond"]) == (inside.min(), inside.max(), outside)


def test_duplicates_nulls_and_dirty_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "bad"), (2, "ok"), (3, "bad")], "a int, t string")
    assert tuple(profile.duplicate_rows(df).first()) == (5, 1)
    nulls = profile.null_profile(df).collect()
    assert [(r["name"], r["nulls"], r["pct"]) for r in nulls] == [("t", 2, 40.0)]
    assert tuple(profile.category_quality(df, "t", ["ok"]).first()) == (1, 2, 2)
    assert [tuple(r) for r in profile.top_dirty(df, "t", ["ok"]).collect()] == [("bad", 2)]


def test_share_at_max_counts_nulls_as_below(spark):
    df = spark.createDataFrame([(0, 5.0), (0, None), (0, 1.0), (1, 5.0), (0, 5.0)], "event int, s double")
    assert profile.share_at_max(df, "s", "event").first()[0] == 0.5


def test_crosstab_margins(df, data):
    got = {(r["c"], r["event"]): r["n"] for r in profile.crosstab(df, "c", "event").collect()}
    want = pd.crosstab(data["c"], data["event"], margins=True)
    assert got[("All", "All")] == len(data) and len(got) == 12
    for c in ("a", "b", "z", "All"):
        for e in (0, 1, "All"):
            assert got[(c, str(e))] == want.loc[c, e]


def test_binned_density_is_close_to_the_exact_one(df, data):
    x = data["x"].dropna().to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    exact = profile.kde(df, "x", bins=None).orderBy("point").toPandas()
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(exact["x"], grid) and np.allclose(exact["density"], want)
    binned = profile.kde(df, "x").orderBy("point").toPandas()
    assert np.abs(binned["density"] - want).max() < 1e-4


def test_correlations_skip_missing_pairs(df, data):
    got = {(r["a"], r["b"]): r["corr"] for r in association.correlation_pairs(df, ["x", "k", "event"]).collect()}
    want = data[["x", "k", "event"]].corr()
    for (a, b), value in got.items():
        assert value == pytest.approx(want.loc[a, b], abs=1e-12)
    ranking = association.correlation_ranking(df, ["k", "x"], "event").collect()
    assert [r["name"] for r in ranking] == ["x", "k"]


def test_welch_by_hand(df, data):
    a, b = (data[data["event"] == e]["x"].dropna() for e in (0, 1))
    va, vb = a.var() / len(a), b.var() / len(b)
    row = association.welch_test(df, ["x"], "event").first()
    assert row["t_stat"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    assert row["df"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    assert row["p_value"] < 0.001 and row["significance"] == "***"


def test_chi2_with_and_without_continuity_correction(df, data):
    got = {r["name"]: r for r in association.chi2_test(df, ["c", "two"], "event").collect()}
    for c in ("c", "two"):
        o = pd.crosstab(data[c], data["event"]).to_numpy(float)
        e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
        gap = np.abs(o - e)
        gap = gap - np.minimum(0.5, gap) if c == "two" else gap
        assert got[c]["chi2"] == pytest.approx((gap**2 / e).sum())
        assert got[c]["df"] == len(o) - 1


def test_weight_of_evidence_matches_pandas(df, data):
    bins = association.woe_bins(df, ["x"], "event", ["c"]).toPandas()
    tmp = data[["x", "event"]].dropna()
    g = tmp.groupby(pd.qcut(tmp["x"], 10, duplicates="drop"), observed=True)["event"].agg(["sum", "count"])
    de, dn = g["sum"] / g["sum"].sum(), (g["count"] - g["sum"]) / (g["count"] - g["sum"]).sum()
    iv = ((de - dn) * np.log((de + 1e-9) / (dn + 1e-9))).sum()
    assert bins[bins["name"] == "x"]["iv_bin"].sum() == pytest.approx(iv)
    ranked = association.iv_ranking(association.woe_bins(df, ["x"], "event", ["c"])).collect()
    assert ranked[0]["name"] == "x" and ranked[0]["iv"] == pytest.approx(iv)


def test_names_that_clash(spark):
    """Columns may be called like the operators' own; a name that is to be added must be free."""
    df = spark.createDataFrame([(1, "x", 2), (1, "x", 2), (2, None, 3)], "copies int, name string, value int")
    assert tuple(profile.duplicate_rows(df).first()) == (3, 1)
    assert [tuple(r) for r in profile.frequencies(df, ["name", "value"]).collect()] == [("name", "x", 2), ("value", "2", 2), ("value", "3", 1)]
    rates = profile.rates_by_category(df.withColumn("n", df["copies"] - 1), ["value"], "n").collect()
    assert [tuple(r) for r in rates] == [("value", "3", 1, 100.0), ("value", "2", 2, 0.0)]
    with pytest.raises(ValueError, match="already"):
        splits.folds(df.withColumn("fold", df["copies"]), "copies", 2)
