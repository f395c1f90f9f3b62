import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import metrics, monitoring, rules, training


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


def brute_pr(y, s):
    out = []
    for t in sorted(set(s)):
        flagged = s >= t
        p, r = y[flagged].mean(), y[flagged].sum() / y.sum()
        out.append((t, p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
    return out


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(11)
    y = (rng.random(900) < 0.25).astype(int)
    s = np.round(np.clip(rng.normal(0.4 + 0.15 * y, 0.2), 0, 1), 2)
    s[:300] = 0.4
    return y, s


@pytest.fixture(scope="module")
def df(spark, scored):
    y, s = scored
    rows = [(i, int(a), float(b), "even" if i % 2 == 0 else "odd") for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "i int, y int, s double, g string").repartition(4).cache()


@pytest.mark.parametrize("digits", [None, 6])
def test_areas_match_brute_force(df, scored, digits):
    y, s = scored
    row = metrics.curve_areas(metrics.score_curve(df, "s", "y", digits=digits)).first()
    pr = brute_pr(y, s)
    recalls = [r for _, _, r, _ in pr] + [0.0]
    ap = sum((recalls[i] - recalls[i + 1]) * pr[i][1] for i in range(len(pr)))
    assert row["roc_auc"] == pytest.approx(brute_auc(y, s)) and row["avg_precision"] == pytest.approx(ap)


def test_areas_per_group_and_one_class(df, scored):
    y, s = scored
    got = {r["g"]: r["roc_auc"] for r in metrics.curve_areas(metrics.score_curve(df, "s", "y", ["g"]), ["g"]).collect()}
    assert got["even"] == pytest.approx(brute_auc(y[::2], s[::2]))
    only = metrics.curve_areas(metrics.score_curve(df.where("y = 0"), "s", "y")).first()
    assert only["roc_auc"] is None and only["avg_precision"] is None


def test_threshold_table_and_picks(df, scored):
    y, s = scored
    curve = metrics.score_curve(df, "s", "y")
    pr = brute_pr(y, s)
    got = metrics.threshold_table(curve).orderBy("threshold").collect()
    assert np.allclose([tuple(r) for r in got], pr)
    f1 = [f for *_, f in pr]
    assert metrics.pick_threshold(curve, "f1").first()[0] == pr[int(np.argmax(f1))][0]
    valid = [t for t, p, _, _ in pr if p >= 0.3]
    assert metrics.pick_threshold(curve, "recall", 0.3).first()[0] == pytest.approx(min(valid))
    assert metrics.pick_threshold(curve, "recall", 1.01).first()[0] == pytest.approx(y.mean())
    assert metrics.pick_threshold(curve, "prior").first()[0] == pytest.approx(y.mean())
    with pytest.raises(ValueError):
        metrics.pick_threshold(curve, "best")
    nearest = min(pr, key=lambda row: (abs(row[0] - 0.333), row[0]))
    assert metrics.nearest_threshold(curve, 0.333).first()["threshold"] == nearest[0]


def test_threshold_is_limited_except_prior(spark):
    df = spark.createDataFrame([(1, 0.999), (0, 0.2)] + [(0, 0.1)] * 300, "y int, s double")
    curve = metrics.score_curve(df, "s", "y")
    assert metrics.pick_threshold(curve, "f1").first()[0] == 0.95
    assert metrics.pick_threshold(curve, "prior").first()[0] == pytest.approx(1 / 302)


def test_curve_ends(df):
    curve = metrics.score_curve(df, "s", "y")
    roc = metrics.roc_points(curve).toPandas()
    assert (roc.loc[roc["threshold"].isna(), ["fpr", "tpr"]].to_numpy() == 0).all()
    assert roc["tpr"].max() == roc["fpr"].max() == 1.0
    last = metrics.pr_points(curve).where("threshold is null").first()
    assert (last["precision"], last["recall"]) == (1.0, 0.0)


def test_summary_by_hand(spark):
    df = spark.createDataFrame([(700, 1), (800, 0), (650, 1), (900, 0)], "x int, y int")
    ruled = rules.add_rule_score(df, [{"col": "x", "op": "<", "threshold": 760}], 1)
    row = metrics.classification_summary(ruled, "score", "pred", "y").first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 0, 2)
    assert row["roc_auc"] == row["avg_precision"] == row["f1"] == row["accuracy"] == 1.0
    none = metrics.rates(metrics.confusion(ruled.withColumn("pred", F.lit(0)), "pred", "y")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    shares = metrics.normalised_confusion(metrics.confusion(ruled, "pred", "y")).collect()
    assert {(r["actual"], r["predicted"]): r["share"] for r in shares} == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_deciles_and_calibration(spark):
    rows = [(0, i / 200) for i in range(90)] + [(1, 0.9 + i / 200) for i in range(10)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.deciles(df, "s", "y").orderBy("decile").collect()
    assert len(got) == 10 and [r["n"] for r in got] == [10] * 10
    assert got[9]["event_rate"] == 1.0 and got[9]["event_rate_pct"] == 100.0 and got[0]["n_event"] == 0
    cal = metrics.calibration(df, "s", "y", 5).orderBy("bin").collect()
    assert [r["n"] for r in cal] == [20] * 5 and cal[4]["event_rate"] == 0.5


def test_stability_index(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=3000), rng.normal(size=3000)
    frame = lambda x: spark.createDataFrame([(float(v), 1.0) for v in x], "x double, flat double")
    same = {r["name"]: r["psi"] for r in monitoring.psi(frame(a), frame(b), ["x", "flat", "absent"]).collect()}
    assert same["x"] < 0.05 and same["flat"] == pytest.approx(0.0) and len(same) == 2
    shifted = monitoring.psi_report(frame(a), frame(b + 3), ["x"]).first()
    assert shifted["psi"] > 0.1 and shifted["status"] == "Drift"
    edges = np.linspace(a.min(), a.max(), 11)
    edges[0] -= 1e-9
    edges[-1] += 1e-9
    p = (np.histogram(a, edges)[0] + 1e-6) / (3000 + 1e-5)
    q = (np.histogram(b + 3, edges)[0] + 1e-6) / (3000 + 1e-5)
    assert shifted["psi"] == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=1e-6)
    assert monitoring.psi(frame(a), frame(b[:1]), ["x"]).count() == 0
    report = monitoring.psi_report(frame(a), frame(b + 3), ["x", "flat"])
    assert monitoring.drifting_columns(report) == ["x"]
    assert tuple(monitoring.drift_summary(report, 0.15).first()) == (1, 0, 1, 0.15, "Monitorear")
    assert not monitoring.enough_rows(frame(a[:5])) and monitoring.enough_rows(frame(a))


def test_position_quarters(spark):
    df = spark.range(10).select((F.col("id") * 7).alias("k"))
    got = monitoring.position_quarters(df, "k").orderBy("k").toPandas()["window"].tolist()
    assert got == [f"Q{q}" for q in (1, 1, 1, 2, 2, 3, 3, 4, 4, 4)]


def test_windows_with_missing_labels(spark):
    df = spark.createDataFrame(
        [("a", 0.9, 1), ("a", 0.2, 0), ("a", 0.8, None), ("b", 0.4, None)], "window string, s double, y int")
    got = {r["window"]: r for r in monitoring.performance_by_window(df, "window", "s", "y", 0.5).collect()}
    assert (got["a"]["n"], got["a"]["n_labeled"], got["a"]["tp"], got["a"]["roc_auc"]) == (3, 2, 1, 1.0)
    assert got["a"]["pct_pred_event"] == pytest.approx(2 / 3)
    assert got["b"]["recall_event"] is None and got["b"]["tp"] is None and got["b"]["roc_auc"] is None
    bare = monitoring.performance_by_window(df.drop("y"), "window", "s", "y", 0.5)
    assert bare.where("window = 'a'").first()["n"] == 3


SPEC = {"name": "lr", "type": "logistic_regression", "params": {"class_weight": "balanced", "max_iter": 50}}


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=800) > 1).astype(int)
    rows = [(i, float(a), float(b), int(e)) for i, ((a, b), e) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, a double, b double, y int").cache()
    return df.where("i < 600"), df.where("i >= 600")


def test_trained_model_beats_chance_and_is_selected(spark, learnable):
    train, test = learnable
    tree = {"name": "tree", "type": "decision_tree", "params": {"max_depth": 1, "class_weight": "balanced"}}
    found = training.train_catalogue([SPEC, tree], train, test, "y", ["a", "b"], "i", k=3)
    rows = {(r["model"], r["split"]): r for r in found["summary"].collect()}
    assert rows[("lr", "Test")]["roc_auc"] > 0.85 and rows[("lr", "Train")]["support_event"] > 0
    assert found["best"].name == "lr"
    cv = {(r["model"], r["metric"]): r for r in found["cv"].collect()}
    assert len(cv) == 10 and 0 <= cv[("lr", "recall")]["mean"] <= 1
    best = training.importances(found["best"], spark).collect()
    assert best[0]["feature"] == "a"
    record = training.model_record(found["best"], found["cv"], found["scores"], train, test, "y", "f1").collect()
    assert len(record) == 1 and record[0]["train_size"] == 600 and record[0]["feature_count"] == 2
    scored = training.add_probability(found["best"].model, test, ["a", "b"]).first()
    assert 0 <= scored["score"] <= 1


def test_weights_and_unknown_type():
    assert training.class_weights({"params": {"class_weight": "balanced"}}, 90, 10) == (100 / 180, 5.0)
    assert training.class_weights({"fit_strategy": "sample_weight_positive"}, 90, 10) == (1.0, 9.0)
    assert training.class_weights({}, 90, 10) == (1.0, 1.0)
    with pytest.raises(ValueError):
        training.make_estimator({"type": "other"}, "y", 1.0)


def test_logistic_regression_matches_newton(spark, learnable):
    """Balanced, penalised fit against a direct solution of the same objective."""
    train, _ = learnable
    spec = {"type": "logistic_regression", "params": {"class_weight": "balanced", "max_iter": 200, "C": 0.5, "tol": 1e-10}}
    model = training.fit_classifier(spec, train, "y", ["a", "b"])
    pdf = train.toPandas()
    y, x = pdf["y"].to_numpy(), np.c_[np.ones(len(pdf)), pdf[["a", "b"]].to_numpy()]
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    beta, pen = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = 0.5 * x.T @ (w * (p - y)) + pen @ beta
        beta = beta - np.linalg.solve(0.5 * (x.T * (w * p * (1 - p))) @ x + pen, grad)
    assert np.allclose([model.intercept, *model.coefficients.toArray()], beta, atol=1e-4)


def test_selection_tie_goes_to_the_earlier_entry(spark):
    scores = spark.createDataFrame([("b", 0.50001, 0.0), ("a", 0.50002, 0.0), ("c", 0.4, 0.0)],
                                   "model string, score double, gap_auc double")
    assert training.best_model(scores, ["b", "a", "c"]).first()["model"] == "b"


def test_rule_folds_and_learning_curve(spark, df):
    ruled = df.withColumn("pred", (F.col("s") >= 0.5).cast("int"))
    folds = training.rule_cross_validation(ruled, "y", "i", 5)
    assert folds.count() == 5
    whole = metrics.rates(metrics.confusion(ruled, "pred", "y"))
    summary = {r["metric"]: r for r in training.rule_cv_summary(folds, whole).collect()}
    assert summary["recall"]["train_score"] == pytest.approx(whole.first()["recall"])
    curve = training.rule_learning_curve(ruled, "y", "i", repeats=4).orderBy("size").collect()
    assert [r["train_rows"] for r in curve] == [72, 234, 396, 558, 720]
    assert len({round(r["test_mean"], 12) for r in curve}) == 1
