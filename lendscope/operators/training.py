"""Spark ML classifiers: catalogue, fit with calibrated threshold, cross-validation, selection."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.expressions import decision
from lendscope.operators.boosting import BoostedTrees, HistogramBoosting
from lendscope.operators.metrics import classification_summary, confusion, pick_threshold, rates, score_curve
from lendscope.operators.splits import folds, shuffle_parts
from lendscope.operators.trees import MOST_SLOTS, Fit, are_numbers, part_counts, tree_confusions
from lendscope.operators.wide import filled_slots
from lendscope.sources.workspace import settle

FEATURES, WEIGHT = "_features", "_weight"
CV_METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc")
#: Independent fits whose jobs run side by side.
FITS_AT_ONCE = 4
CURVE_METRICS = {
    "accuracy": lambda tn, fp, fn, tp: (tp + tn) / max(tn + fp + fn + tp, 1),
    "precision": lambda tn, fp, fn, tp: tp / max(tp + fp, 1),
    "recall": lambda tn, fp, fn, tp: tp / max(tp + fn, 1),
    "f1": lambda tn, fp, fn, tp: 2 * tp / max(2 * tp + fp + fn, 1),
}

# The model catalogue used when none is given.
DEFAULT_MODELS = [
    {"name": "Logistic Regression", "type": "logistic_regression",
     "params": {"class_weight": "balanced", "max_iter": 1000, "C": 0.1}},
    {"name": "Decision Tree", "type": "decision_tree",
     "params": {"class_weight": "balanced", "max_depth": 5, "min_samples_leaf": 20}},
    {"name": "Random Forest", "type": "random_forest",
     "params": {"class_weight": "balanced", "n_estimators": 200, "max_depth": 8, "min_samples_leaf": 10}},
    {"name": "Gradient Boosting", "type": "gradient_boosting",
     "params": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 4, "min_samples_leaf": 10,
                "subsample": 0.8},
     "fit_strategy": "sample_weight_positive"},
]

# Weights of the selection score.
DEFAULT_WEIGHTS = {"roc_auc": 0.4, "pr_auc": 0.3, "recall": 0.2, "gap": 0.1}


@dataclass
class Fitted:
    """A fitted classifier with its decision threshold and metrics per split."""

    name: str
    model: Model | BoostedTrees
    features: list[str]
    threshold: float
    fit_time: float = 0.0
    summary: DataFrame | None = field(default=None, repr=False)
    slots: list[str] = field(default_factory=list, repr=False)


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return row["n0"], row["n1"]


def class_weights(spec: Mapping, n0: int, n1: int) -> tuple[float, float]:
    """Row weights of the two classes: balanced, raised for events only, or equal."""
    if spec.get("fit_strategy") == "sample_weight_positive":
        return 1.0, n0 / max(n1, 1)
    if str(spec.get("params", {}).get("class_weight", "")).startswith("balanced"):
        return (n0 + n1) / (2.0 * max(n0, 1)), (n0 + n1) / (2.0 * max(n1, 1))
    return 1.0, 1.0


_TREE = {"max_depth", "min_samples_leaf", "random_state"}
KNOWN_PARAMS = {
    "logistic_regression": {"max_iter", "C", "tol", "class_weight", "random_state"},
    "decision_tree": {*_TREE, "class_weight"},
    "random_forest": {*_TREE, "n_estimators", "max_features", "class_weight"},
    "gradient_boosting": {*_TREE, "n_estimators", "learning_rate", "subsample", "max_features"},
    "hist_gradient_boosting": {*_TREE, "max_iter", "learning_rate", "max_bins", "max_leaf_nodes", "l2_regularization", "class_weight"},
}
DEEPEST = 30  # Spark's own limit


def make_estimator(spec: Mapping, label: str, total_weight: float) -> Estimator | HistogramBoosting:
    """The estimator for one catalogue entry; a parameter it would not use is refused.

    Where a parameter is absent, each type has its usual default: trees and forests grow until their leaves are
    pure (to Spark's depth limit), boosting stops at depth 3, histogram boosting keeps 20 rows a leaf.
    """
    kind, p = spec["type"], dict(spec.get("params", {}))
    if kind not in KNOWN_PARAMS:
        raise ValueError(f"unknown model type {kind!r}")
    unknown = sorted(set(p) - KNOWN_PARAMS[kind])
    if unknown:
        raise ValueError(f"{kind} has no parameter {unknown}; known: {sorted(KNOWN_PARAMS[kind])}")
    common = dict(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT)

    def tree(depth: int | None, leaf: int) -> dict:
        return dict(maxDepth=p.get("max_depth", depth) or DEEPEST, minInstancesPerNode=p.get("min_samples_leaf", leaf),
                    seed=p.get("random_state", 42))

    def subset(default: str) -> str:
        wanted = p.get("max_features", default)
        return "all" if wanted is None else str(wanted)

    if kind == "logistic_regression":
        return LogisticRegression(
            maxIter=p.get("max_iter", 100), regParam=1.0 / (p.get("C", 1.0) * total_weight),
            elasticNetParam=0.0, standardization=False, tol=p.get("tol", 1e-6), **common,
        )
    if kind == "decision_tree":
        return DecisionTreeClassifier(**tree(None, 1), **common)
    if kind == "random_forest":
        return RandomForestClassifier(
            numTrees=p.get("n_estimators", 100), featureSubsetStrategy=subset("sqrt"), **tree(None, 1), **common)
    if kind == "gradient_boosting":
        return GBTClassifier(
            maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1),
            subsamplingRate=p.get("subsample", 1.0), featureSubsetStrategy=subset("all"), **tree(3, 1), **common,
        )
    return HistogramBoosting(
        FEATURES, label, WEIGHT, trees=p.get("max_iter", 100), learning_rate=p.get("learning_rate", 0.1), max_depth=p.get("max_depth"),
        max_leaf_nodes=p.get("max_leaf_nodes", 31), min_samples_leaf=p.get("min_samples_leaf", 20),
        max_bins=min(p.get("max_bins", 255), 255), l2=p.get("l2_regularization", 0.0),
    )


def feature_columns(df: DataFrame, label: str, keep: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != label and c not in keep]


def slot_names(df: DataFrame, features: Sequence[str]) -> list[str]:
    """A name for each slot of the assembled vector; slots of a vector column are numbered from 0."""
    wide = [c for c in features if isinstance(df.schema[c].dataType, VectorUDT)]
    sizes = df.select(*[filled_slots(c)["size"].alias(c) for c in wide]).first() if wide else {}
    return [name for c in features for name in ([f"{c}[{i}]" for i in range(sizes[c])] if c in wide else [c])]


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error").transform(df)


def fit_assembled(spec: Mapping, rows: DataFrame, label: str, n0: int, n1: int) -> Model | BoostedTrees:
    """Fit on rows that hold the feature vector and the label, ``n0`` and ``n1`` of them in the two classes."""
    w0, w1 = class_weights(spec, n0, n1)
    return make_estimator(spec, label, n0 * w0 + n1 * w1).fit(rows.withColumn(WEIGHT, F.when(F.col(label) == 1, w1).otherwise(w0)))


def fit_classifier(
    spec: Mapping, train: DataFrame, label: str, features: Sequence[str], partitions: int | None = None
) -> Model | BoostedTrees:
    """Fit on assembled, weighted rows. The input is kept for the iterations, then released.

    Every iteration is a job over all partitions. ``partitions`` gathers the rows in so many; bagging and
    subsampling draw by partition, so a fit is repeated exactly only over the same partitions.
    """
    n0, n1 = class_counts(train, label)
    ready = assemble(train, features).select(FEATURES, F.col(label).cast("double").alias(label))
    ready = (ready.coalesce(partitions) if partitions else ready).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_assembled(spec, ready, label, n0, n1)
    finally:
        ready.unpersist()


def together(work: Callable, items: Sequence, at_once: int = FITS_AT_ONCE) -> list:
    """``work`` of every item, at most ``at_once`` at a time: the jobs of independent fits fill each other's gaps."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


@dataclass
class FoldMatrix:
    """The assembled training rows with their fold, kept once for all models and folds."""

    rows: DataFrame
    label: str
    k: int
    counts: dict[tuple[int, int], int]

    def classes(self, without: int | None = None) -> tuple[int, int]:
        """Rows of the two classes outside one fold."""
        n0, n1 = (sum(n for (fold, c), n in self.counts.items() if c == of and fold != without) for of in (0, 1))
        return n0, n1

    def release(self) -> None:
        self.rows.unpersist()


def fold_matrix(
    train: DataFrame, label: str, features: Sequence[str], key: str, k: int = 5, partitions: int | None = None
) -> FoldMatrix:
    """Class-wise folds over the assembled rows, persisted; ``partitions`` as in ``fit_classifier``."""
    tagged = assemble(folds(train, key, k, [label]), features).select(FEATURES, F.col(label).cast("double").alias(label), "fold")
    rows = (tagged.coalesce(partitions) if partitions else tagged).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {(r["fold"], int(r[label])): r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy("fold", label).count().collect()}
    return FoldMatrix(rows, label, k, counts)


def add_probability(model: Model, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """The rows with the model's probability of an event, worked out once a row however often, or in which filters, it is used."""
    scored = model.transform(assemble(df, features))
    return scored.select(*df.columns, F.explode(F.array(vector_to_array("probability")[1])).alias(out))  # conditions stay above a generator


def choose_threshold(scored: DataFrame, label: str, strategy: str, min_precision: float) -> float:
    curve = score_curve(scored, "score", label)
    return float(pick_threshold(curve, strategy, min_precision).first()["threshold"])


def train_model(
    spec: Mapping, train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
    strategy: str = "f1", min_precision: float = 0.05, matrix: FoldMatrix | None = None,
) -> Fitted:
    """Fit, calibrate the threshold on train alone, and measure both splits. ``matrix`` holds the training rows where they are assembled already."""
    started = time.time()
    model = fit_assembled(spec, matrix.rows, label, *matrix.classes()) if matrix else fit_classifier(spec, train, label, features)
    fit_time = round(time.time() - started, 2)
    parts = [
        add_probability(model, part, features).select(F.lit(name).alias("split"), label, "score")
        for name, part in (("Train", train), ("Test", test))
    ]
    both = parts[0].unionByName(parts[1]).persist(StorageLevel.MEMORY_AND_DISK)
    threshold = choose_threshold(both.where("split = 'Train'"), label, strategy, min_precision)
    judged = both.withColumn("pred", decision(F.col("score"), threshold))
    summary = classification_summary(judged, "score", "pred", label, ["split"]).select(
        F.lit(spec.get("name", spec["type"])).alias("model"), "split", F.lit(threshold).alias("threshold"),
        "roc_auc", F.col("avg_precision").alias("pr_auc"), "accuracy", F.col("precision").alias("precision_event"),
        F.col("recall").alias("recall_event"), F.col("f1").alias("f1_event"), F.col("support").alias("support_event"),
        "tn", "fp", "fn", "tp", F.lit(fit_time).alias("fit_time"),
    )
    summary = settle(summary)
    both.unpersist()
    return Fitted(spec.get("name", spec["type"]), model, list(features), threshold, fit_time, summary, slot_names(train, features))


def cross_validate(
    spec: Mapping, train: DataFrame, label: str, features: Sequence[str], key: str, k: int = 5,
    strategy: str = "f1", min_precision: float = 0.05, matrix: FoldMatrix | None = None, at_once: int = FITS_AT_ONCE,
) -> DataFrame:
    """``(model, fold, accuracy, f1, precision, recall, roc_auc)``: class-wise folds, each with the
    threshold calibrated on its own training rows.

    All folds are fitted on one assembled matrix (``matrix``, where several models share it), ``at_once`` at a time. One pass then
    scores every row by every fold's model, and curves, thresholds and metrics are grouped by fit.
    """
    own = matrix or fold_matrix(train, label, features, key, k)
    models = together(lambda i: fit_assembled(spec, own.rows.where(F.col("fold") != i), label, *own.classes(i)), range(own.k), at_once)
    scored = own.rows.withColumn("_scores", F.array().cast("array<double>"))
    for model in models:
        scored = model.transform(scored).select(
            FEATURES, label, "fold", F.concat("_scores", F.array(vector_to_array("probability")[1])).alias("_scores"))
    scored = scored.select(label, "fold", "_scores").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = scored.select(label, "fold", F.posexplode("_scores").alias("fit", "score")).where(F.col("fold") != F.col("fit"))
        picked = pick_threshold(score_curve(fitted, "score", label, ["fit"]), strategy, min_precision, ["fit"])
        cuts = {r["fit"]: float(r["threshold"]) for r in picked.collect()}
        limits = F.array(*[F.lit(cuts.get(i)).cast("double") for i in range(own.k)])
        held = scored.select(label, "fold", F.get("_scores", F.col("fold").cast("int")).alias("score"), F.get(limits, F.col("fold").cast("int")).alias("cut"))
        held = held.withColumn("pred", (F.col("score") >= F.col("cut")).cast("int"))
        result = classification_summary(held, "score", "pred", label, ["fold"])
        return settle(result.select(F.lit(spec.get("name", spec["type"])).alias("model"), "fold", *CV_METRICS))
    finally:
        scored.unpersist()
        if matrix is None:
            own.release()


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population spread of each metric over the folds."""
    long = scores.unpivot(["model", "fold"], list(CV_METRICS), "metric", "value")
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _tree_slots(spec: Mapping, rows: DataFrame) -> int:
    """Slots of the feature vector where the fits are single trees that ``tree_confusions`` grows, else 0."""
    if spec["type"] != "decision_tree" or not are_numbers(rows, FEATURES):
        return 0
    slots = rows.select(F.size(vector_to_array(FEATURES)).alias("n")).first()["n"]
    return slots if slots <= MOST_SLOTS else 0


def learning_curve(
    spec: Mapping, train: DataFrame, label: str, features: Sequence[str], key: str, repeats: int = 30,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), test_size: float = 0.2, metric: str = "recall",
    partitions: int | None = None, at_once: int = FITS_AT_ONCE,
) -> DataFrame:
    """``metric`` on growing training parts and on the held-out part, with spread and fit time.

    Predictions use the plain one-half rule. Every size and repeat needs its own fit, on the rows by their part in that repeat. Single trees on
    numbers are grown together, a scan a level for all fits (``tree_confusions``); their fit time is the tasks' time spent on the fit. Other models are
    fitted one by one from one assembled matrix. ``metric`` is accuracy, precision, recall or f1. A part without an event cannot be
    fitted and counts 0.
    """
    if metric not in CURVE_METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(CURVE_METRICS)}")
    parts = shuffle_parts(train, key, repeats, sizes, test_size)
    rows = assemble(parts, features).select(FEATURES, F.col(label).cast("double").alias(label), "parts")
    counts, plain = part_counts(rows, label, repeats)
    classes = {(r, size): tuple(int(n) for n in counts[r, 1:size + 1].sum(0)) for r in range(repeats) for size in range(1, len(sizes) + 1)}
    usable = [fit for fit, own in classes.items() if min(own)]
    score = lambda found, side: CURVE_METRICS[metric](*found[side]) if sum(found.get(side, ())) else 0.0
    slots = _tree_slots(spec, rows) if usable and plain else 0
    if slots:
        fits = [Fit(r, size, classes[r, size], class_weights(spec, *classes[r, size])) for r, size in usable]
        tree = make_estimator(spec, label, 1.0)
        found = tree_confusions(rows, FEATURES, label, fits, slots, tree.getMaxDepth(), tree.getMinInstancesPerNode(), tree.getMaxBins(), tree.getSeed())
        measured = [(fit.size, score(sides, True), score(sides, False), fit.seconds) for fit, sides in zip(fits, found)]
    else:
        rows = (rows.coalesce(partitions) if partitions else rows).persist(StorageLevel.MEMORY_AND_DISK)

        def one(fit: tuple[int, int]) -> tuple:
            r, size = fit
            used = rows.withColumn("part", F.get("parts", F.lit(r))).where(F.col("part") <= size)
            started = time.time()
            model = fit_assembled(spec, used.where("part > 0"), label, *classes[fit])
            fit_time = time.time() - started
            judged = model.transform(used).select(label, (F.col("part") > 0).alias("known"), (vector_to_array("probability")[1] >= 0.5).cast("int").alias("pred"))
            sides = {c["known"]: tuple(c[n] for n in ("tn", "fp", "fn", "tp")) for c in confusion(judged, "pred", label, ["known"]).collect()}
            return size, score(sides, True), score(sides, False), fit_time

        try:
            measured = together(one, usable, at_once)
        finally:
            rows.unpersist()
    measured += [(size, 0.0, 0.0, 0.0) for (_, size), own in classes.items() if not min(own)]
    table = train.sparkSession.createDataFrame(measured, "size int, train double, test double, fit_time double")
    return table.groupBy("size").agg(*[
        agg(c).alias(f"{c}_{n}") for c in ("train", "test", "fit_time")
        for n, agg in (("mean", F.avg), ("std", F.stddev_pop))
    ])


def rule_cross_validation(scored: DataFrame, label: str, key: str, k: int = 10) -> DataFrame:
    """Fold metrics of a rule model, which needs no fit: one grouped pass over all folds."""
    tagged = folds(scored, key, k)
    return rates(confusion(tagged, "pred", label, ["fold"])).select("fold", "accuracy", "f1", "precision", "recall")


def rule_cv_summary(fold_scores: DataFrame, train_scores: DataFrame) -> DataFrame:
    """Mean and sample spread over the folds beside the metric on all training rows."""
    names = ["accuracy", "f1", "precision", "recall"]
    long = fold_scores.unpivot(["fold"], names, "metric", "value").groupBy("metric").agg(
        F.avg("value").alias("cv_mean"), F.stddev_samp("value").alias("cv_std"))
    whole = train_scores.select(*names).unpivot([], names, "metric", "train_score")
    return long.join(F.broadcast(whole), "metric")


def rule_learning_curve(
    scored: DataFrame, label: str, key: str, repeats: int = 30,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), test_size: float = 0.2,
) -> DataFrame:
    """Recall of a rule model on growing parts; one grouped pass over all repeats and sizes."""
    slim = scored.select(key, label, "pred")
    tagged = shuffle_parts(slim, key, repeats, sizes, test_size)
    each = tagged.select(label, "pred", F.posexplode("parts").alias("repeat", "part"))  # three small numbers, folded before the shuffle
    cells = each.groupBy("repeat", "part").agg(
        F.count_if((F.col("pred") == 1) & (F.col(label) == 1)).alias("tp"),
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count(F.lit(1)).alias("rows"),
    )
    cells = settle(cells)  # a row per repeat and part, read twice
    # A training part of size i is made of the slices 1 to i.
    grown = cells.where("part > 0").select(
        "repeat", F.explode(F.sequence(F.col("part"), F.lit(len(sizes)))).alias("size"), "tp", "pos", "rows"
    ).groupBy("repeat", "size").agg(F.sum("tp").alias("tp"), F.sum("pos").alias("pos"), F.sum("rows").alias("rows"))
    held = cells.where("part = 0").select("repeat", F.col("tp").alias("test_tp"), F.col("pos").alias("test_pos"))
    rate = lambda tp, pos: F.when(F.col(pos) > 0, F.col(tp) / F.col(pos)).otherwise(0.0)
    joined = grown.join(held, "repeat")
    return joined.groupBy("size").agg(
        F.max("rows").alias("train_rows"),
        F.avg(rate("tp", "pos")).alias("train_mean"), F.stddev_pop(rate("tp", "pos")).alias("train_std"),
        F.avg(rate("test_tp", "test_pos")).alias("test_mean"),
        F.stddev_pop(rate("test_tp", "test_pos")).alias("test_std"),
    )


def selection_scores(summary: DataFrame, cv: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``(model, score, gap_auc)``: weighted CV and test quality, less the train-test gap."""
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    pick = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c)))
    by_model = summary.groupBy("model").agg(
        pick("pr_auc", "Test").alias("pr_test"),
        F.abs(pick("roc_auc", "Train") - pick("roc_auc", "Test")).alias("gap_auc"),
    )
    means = cv.groupBy("model").agg(
        F.max(F.when(F.col("metric") == "roc_auc", F.col("mean"))).alias("roc_cv"),
        F.max(F.when(F.col("metric") == "recall", F.col("mean"))).alias("recall_cv"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (
        w["roc_auc"] * zero("roc_cv") + w["pr_auc"] * zero("pr_test")
        + w["recall"] * zero("recall_cv") - w["gap"] * zero("gap_auc")
    )
    return by_model.join(means, "model", "left").select("model", score.alias("score"), "gap_auc")


def best_model(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """The highest score; equal scores (to four digits) resolve to the earlier catalogue entry."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return scores.orderBy(F.round("score", 4).desc(), place).limit(1)


def importances(fitted: Fitted, spark, top: int = 20) -> DataFrame | None:
    """``(feature, importance)`` for the strongest features, or None for a model without any."""
    if hasattr(fitted.model, "featureImportances"):
        values = fitted.model.featureImportances.toArray()
    elif hasattr(fitted.model, "coefficients"):
        values = abs(fitted.model.coefficients.toArray())
    else:
        return None
    rows = [(f, float(v)) for f, v in zip(fitted.slots or fitted.features, values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)


def model_record(
    fitted: Fitted, cv: DataFrame, scores: DataFrame, train: DataFrame, test: DataFrame, label: str,
    strategy: str, baseline_roc: float = 0.0,
) -> DataFrame:
    """One row describing the chosen model; ``model_path`` of ``save_model`` belongs beside it."""
    size = lambda d, p: d.agg(
        F.count(F.lit(1)).alias(f"{p}_size"), F.avg(label).alias(f"{p}_event_rate")).withColumn("_one", F.lit(1))
    measured = fitted.summary.where("split = 'Test'").withColumn("_one", F.lit(1))
    chosen = scores.where(F.col("model") == fitted.name).drop("model").withColumn("_one", F.lit(1))
    means = cv.where(F.col("model") == fitted.name).groupBy(F.lit(1).alias("_one")).pivot(
        "metric", list(CV_METRICS)).agg(F.first("mean"))
    means = means.select("_one", *[F.col(m).alias(f"cv_{m}") for m in CV_METRICS])
    row = measured
    for part in (chosen, means, size(train, "train"), size(test, "test")):
        row = row.join(part, "_one", "left")
    return row.drop("_one").withColumns({
        "threshold_strategy": F.lit(strategy), "baseline_roc": F.lit(float(baseline_roc)),
        "feature_count": F.lit(len(fitted.features)),
    })


def train_catalogue(
    specs: Sequence[Mapping] | None, train: DataFrame, test: DataFrame, label: str, features: Sequence[str],
    key: str, k: int = 5, strategy: str = "f1", min_precision: float = 0.05,
    weights: Mapping[str, float] | None = None, partitions: int | None = None,
) -> dict:
    """Fit and cross-validate every entry on one matrix and choose the best one."""
    specs = list(specs or DEFAULT_MODELS)
    matrix = fold_matrix(train, label, features, key, k, partitions)
    try:
        fitted = {s.get("name", s["type"]): train_model(s, train, test, label, features, strategy, min_precision, matrix) for s in specs}
        folded = [cross_validate(s, train, label, features, key, k, strategy, min_precision, matrix) for s in specs]
    finally:
        matrix.release()
    means = cv_summary(reduce(DataFrame.unionByName, folded))
    summary = reduce(DataFrame.unionByName, [f.summary for f in fitted.values()])
    scores = selection_scores(summary, means, weights)
    name = best_model(scores, list(fitted)).first()["model"]
    return {"fitted": fitted, "summary": summary, "cv": means, "scores": scores, "best": fitted[name]}
