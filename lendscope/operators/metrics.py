"""Classification metrics from one table of counts per distinct score.

Rows are first reduced to ``(group, score, events, others)``; every curve and area follows from
running totals over that table, exact for ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.functions import constants as K
from lendscope.functions.expressions import as_number, edge_bin
from lendscope.operators.quantiles import collected_quantiles, even_probs
from lendscope.operators.running import running_totals

LOGGED_DIGITS = 6
CURVE_NAMES = {"cum_pos": "tp", "cum_neg": "fp", "total_pos": "p", "total_neg": "n"}


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Events and other rows per group and distinct score; rows without score or label are left out, NaN scores too."""
    value = F.round(F.col(score), digits) if digits is not None else F.col(score)
    rows = df.select(*by, value.alias("score"), F.col(label).cast("int").alias("actual"))
    rows = rows.where(as_number("score").isNotNull() & F.col("actual").isNotNull())
    return rows.groupBy(*by, "score").agg(
        F.sum("actual").alias("pos"), F.sum(1 - F.col("actual")).alias("neg")
    )


def score_curve(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), digits: int | None = None, levels: int | None = None
) -> DataFrame:
    """``(by..., score, pos, neg, tp, fp, p, n)``: counts at or above each score, and class totals.

    ``digits`` rounds probabilities first, which bounds the table by ``10**digits + 1`` rows per
    group; ``levels`` states another proven bound. Without either the bound is looked up.
    """
    if levels is None and digits is not None:
        levels = 10**digits + 1
    counts = score_counts(df, score, label, by, digits)
    cum = running_totals(counts, "score", ["pos", "neg"], by, levels=levels, window_rows=1_000_001)
    return cum.withColumnsRenamed(CURVE_NAMES)


def curve_areas(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per group; null where a class is missing."""
    return (
        curve.groupBy(*by)
        .agg(
            F.expr("CAST(sum(pos) AS DOUBLE) AS p"),
            F.expr("CAST(sum(neg) AS DOUBLE) AS n"),
            F.expr("sum(CAST(neg AS DOUBLE) * (tp - pos / 2D)) AS wins"),
            F.expr("sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) AS gain"),
        )
        .select(
            *by,
            F.expr("CASE WHEN p > 0 AND n > 0 THEN wins / (p * n) END AS roc_auc"),
            F.expr("CASE WHEN p > 0 THEN gain / p END AS avg_precision"),
        )
    )


def confusion(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    hit = lambda p, a: F.count_if((F.col(pred) == p) & (F.col(label) == a))
    return df.groupBy(*by).agg(
        hit(0, 0).alias("tn"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(1, 1).alias("tp")
    )


def normalised_confusion(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., actual, predicted, n, share)``, shares within each actual class."""
    cells = counts.selectExpr(
        *by, "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)"
    )
    row = F.sum("n").over(W.partitionBy(*by, "actual"))
    return cells.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def _or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and support from ``tn, fp, fn, tp``; empty divisors give 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
        "accuracy": _or_zero(tp + tn, tp + fp + fn + tn),
        "support": tp + fn,
    })


def classification_summary(
    df: DataFrame, score: str, pred: str, label: str, by: Sequence[str] = (), digits: int | None = None,
    levels: int | None = None,
) -> DataFrame:
    """One row per group: confusion counts, rates, ROC-AUC and average precision."""
    counts = rates(confusion(df, pred, label, by))
    areas = curve_areas(score_curve(df, score, label, by, digits, levels), by)
    if by:
        on = [counts[c].eqNullSafe(areas[c]) for c in by]
        return counts.join(areas, on, "left").select(counts["*"], "roc_auc", "avg_precision")
    counts = counts.withColumn("_one", F.lit(1))
    areas = areas.withColumn("_one", F.lit(1))
    return counts.join(areas, "_one", "left").drop("_one")


def roc_points(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., threshold, fpr, tpr)`` for each distinct score, after a start row at (0, 0)."""
    points = curve.selectExpr(
        *by, "score AS threshold", "fp / CAST(nullif(n, 0) AS DOUBLE) AS fpr", "tp / CAST(nullif(p, 0) AS DOUBLE) AS tpr"
    )
    start = curve.groupBy(*by).agg(F.count(F.lit(1))).selectExpr(
        *by, "CAST(NULL AS DOUBLE) AS threshold", "0D AS fpr", "0D AS tpr")
    return points.unionByName(start)


def threshold_table(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 when rows at or above each distinct score are flagged."""
    table = curve.selectExpr(
        *by, "score AS threshold", "tp / CAST(tp + fp AS DOUBLE) AS precision",
        "tp / CAST(nullif(p, 0) AS DOUBLE) AS recall",
    )
    pr = F.col("precision") + F.col("recall")
    return table.withColumn(
        "f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0)
    )


def pr_points(curve: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)``; the closing point (1, 0) has no threshold."""
    table = threshold_table(curve).select("threshold", "precision", "recall")
    last = curve.agg(F.count(F.lit(1))).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return table.unionByName(last)


def pick_threshold(curve: DataFrame, strategy: str = "f1", min_precision: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., threshold)``, one row per group; equal candidates resolve to the lowest.

    ``f1``: best F1. ``recall``: best recall among thresholds with enough precision, else the event
    rate. Both are kept within fixed limits. ``prior``: the event rate, unlimited.
    """
    prior = F.expr("sum(pos) / CAST(sum(pos + neg) AS DOUBLE)")
    if strategy == "prior":
        return curve.groupBy(*by).agg(prior.alias("threshold"))
    if strategy not in ("f1", "recall"):
        raise ValueError(f"unknown strategy {strategy!r}; known: f1, recall, prior")
    # The same quotients as in the threshold table, so that near-equal candidates rank alike.
    tp = F.col("tp").cast("double")
    precision, recall = tp / (F.col("tp") + F.col("fp")), tp / F.nullif(F.col("p"), F.lit(0))
    if strategy == "f1":
        both = precision + recall
        rank, valid = F.when(both > 0, 2 * precision * recall / both).otherwise(0.0), F.lit(True)
    else:
        rank, valid = recall, precision >= F.lit(float(min_precision))
    best = F.max(F.when(valid, F.struct(rank.alias("rank"), (-F.col("score")).alias("low"))))
    picked = curve.groupBy(*by).agg(best.alias("best"), prior.alias("prior"))
    threshold = F.coalesce(-F.col("best")["low"], F.col("prior"))
    limited = F.least(F.greatest(threshold, F.lit(K.THRESHOLD_FLOOR)), F.lit(K.THRESHOLD_CEILING))
    return picked.select(*by, limited.alias("threshold"))


def nearest_threshold(curve: DataFrame, current: float) -> DataFrame:
    """The row of the threshold table closest to the threshold in use."""
    gap = F.abs(F.col("threshold") - F.lit(float(current)))
    return threshold_table(curve).orderBy(gap, "threshold").limit(1)


def _score_edges(df: DataFrame, score: str, parts: int) -> list[float]:
    found = collected_quantiles(df, [score], even_probs(parts))
    if score not in found:
        raise ValueError(f"{score!r} holds no value")
    return found[score]


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score against event rate in quantile bins; empty bins are absent."""
    inner = _score_edges(df, score, bins)[1:-1]
    slot = F.lit(0)
    for e in inner:
        slot = slot + F.when(F.col(score) > F.lit(e), 1).otherwise(0)
    rows = df.where(F.col(score).isNotNull())
    return rows.groupBy(slot.alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(label).alias("event_rate"), F.count(F.lit(1)).alias("n")
    )


def deciles(df: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """Counts, events and score range per quantile bin, 1 holding the lowest scores."""
    edges = sorted(set(_score_edges(df, score, parts)))
    rows = df.where(F.col(score).isNotNull())
    return (
        rows.groupBy(edge_bin(F.col(score), edges[:-1]).alias("decile"))
        .agg(
            F.count(label).alias("n"), F.sum(label).alias("n_event"),
            F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(score).alias("score_mean"),
        )
        .withColumn("event_rate", F.col("n_event") / F.nullif(F.col("n"), F.lit(0)))
        .withColumn("event_rate_pct", F.round(F.col("event_rate") * 100, 2))
    )


def beats_baseline(summary: DataFrame, baseline: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Each model's metric beside the baseline's on the same split, and whether it is higher."""
    base = baseline.select("split", F.col(metric).alias("baseline"))
    return summary.join(base, "split").select(
        "model", "split", metric, "baseline", (F.col(metric) > F.col("baseline")).alias("beats_baseline")
    )


def metrics_overview(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("split").asc(), F.col("roc_auc").desc())
