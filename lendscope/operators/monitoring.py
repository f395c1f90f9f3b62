"""Drift and performance of scored production rows against a training reference."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import constants as K
from lendscope.functions.expressions import month_key, psi_status
from lendscope.operators.metrics import curve_areas, score_curve
from lendscope.operators.profile import equal_width_place, histogram
from lendscope.operators.quantiles import exact_quantiles, unpivot_numbers
from lendscope.sources.workspace import ensure_checkpoint_dir, settle

log = logging.getLogger(__name__)
EDGE_SLACK = 1e-9


def _bin_counts(df: DataFrame, spans: DataFrame, columns: Sequence[str], bins: int, side: str) -> DataFrame:
    """``(name, bin, side, n)``; bin -1 stands for values outside the reference range."""
    long = unpivot_numbers(df, columns).join(F.broadcast(spans), "name")  # one span row per listed column
    inside = f"value >= lo - {EDGE_SLACK!r}D AND value <= hi + {EDGE_SLACK!r}D"
    clamped = long.selectExpr("name", "lo", "width", f"IF({inside}, greatest(least(value, hi), lo), NULL) AS v")
    inside_place = equal_width_place("v", "lo", "width", bins)
    place = F.when(F.col("v").isNull(), F.lit(-1)).otherwise(inside_place).cast("long")
    return clamped.groupBy("name", place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "side", F.lit(side))


def psi(reference: DataFrame, production: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``(name, psi)``: stability index of each column over equal-width bins of the reference.

    Production values outside the reference range belong to no bin but count as rows. A column with
    fewer than two values on either side is left out.
    """
    present = [c for c in columns if c in reference.columns and c in production.columns]
    ranges = unpivot_numbers(reference, present).groupBy("name").agg(
        F.min("value").alias("a"), F.max("value").alias("b"))
    spans = settle(ranges.selectExpr(
        "name", "IF(a = b, a - 0.5D, a) AS lo", "IF(a = b, b + 0.5D, b) AS hi",
        f"IF(a = b, 1D, b - a) / {bins} AS width",
    ))
    counts = _bin_counts(reference, spans, present, bins, "ref").unionByName(
        _bin_counts(production, spans, present, bins, "prod"))
    per_bin = counts.groupBy("name", "bin").agg(
        F.sum(F.when(F.col("side") == "ref", F.col("n")).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("side") == "prod", F.col("n")).otherwise(0)).alias("p"),
    )
    # One row per column with its bin counts as a map; bins nobody fell in count as zero.
    packed = per_bin.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "p")))).alias("m"),
        F.sum("r").alias("nr"), F.sum("p").alias("np"),
    ).where("nr >= 2 AND np >= 2")
    eps = f"{K.PSI_EPSILON!r}D"
    share = lambda field, n: (
        f"(coalesce(m[i].{field}, 0) + {eps}) / ({n} + {bins} * {eps})"
    )
    p, q = share("r", "nr"), share("p", "np")
    return packed.selectExpr(
        "name",
        f"aggregate(sequence(0L, {bins - 1}L), 0D, (acc, i) -> acc + ({q} - {p}) * ln(({q}) / ({p}))) AS psi",
    )


def psi_report(
    reference: DataFrame, production: DataFrame, columns: Sequence[str], bins: int = 10,
    stable: float = K.PSI_STABLE_BELOW, monitor: float = K.PSI_MONITOR_BELOW,
) -> DataFrame:
    found = psi(reference, production, columns, bins).withColumn("psi", F.round("psi", 6))
    return found.withColumn("status", psi_status(F.col("psi"), stable, monitor)).orderBy(F.col("psi").desc(), "name")


def month_window(ts: Column) -> Column:
    """Calendar month of the prediction; rows without a date share the window ``unknown``."""
    return F.coalesce(month_key(ts), F.lit("unknown"))


def position_quarters(df: DataFrame, order_key: str, out: str = "window") -> DataFrame:
    """Label rows ``Q1`` to ``Q4`` by their position in the order of a unique key of any orderable type.

    Rows without a key come last. The keys are sorted in ranges and written once with their place in the
    range; range sizes tell in which range and place the three cuts lie, so no task orders the whole table.
    """
    keys = df.select(F.col(order_key).alias("key"))
    ranged = keys.repartitionByRange(F.asc_nulls_last("key")).sortWithinPartitions(F.asc_nulls_last("key"))
    ensure_checkpoint_dir(df.sparkSession)
    # The number holds the range in its upper bits and the place in the range in its lower ones.
    placed = ranged.select("key", F.monotonically_increasing_id().alias("place")).checkpoint()
    sizes = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    wanted, before = [], 0
    cuts = [(total - 1) * q // 4 for q in (1, 2, 3)] if total else []
    for r in sorted(sizes, key=lambda r: r["range"]):
        wanted += [(r["range"] << 33) + c - before for c in cuts if before <= c < before + r["n"]]
        before += r["n"]
    found = {r["place"]: r["key"] for r in placed.where(F.col("place").isin(wanted)).collect()} if wanted else {}
    value, label = F.col(order_key), F.lit("Q4")
    for quarter, place in reversed(list(enumerate(wanted, 1))):
        cut = found[place]
        upto = F.lit(True) if cut is None else value.isNotNull() & (value <= F.lit(cut))
        label = F.when(upto, f"Q{quarter}").otherwise(label)
    return df.withColumn(out, label)


def window_aggregates(threshold: float, score: str, actual: str) -> list[Column]:
    s, a = F.col(score), F.col(actual)
    flagged, known = s >= F.lit(float(threshold)), a.isNotNull()
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(s).alias("score_mean"),
        F.stddev_samp(s).alias("score_std"),
        F.avg(F.coalesce(flagged, F.lit(False)).cast("double")).alias("pct_pred_event"),
        F.count(a).alias("n_labeled"),
        F.avg(a.cast("double")).alias("event_rate_real"),
        F.count_if(known & flagged & (a == 1)).alias("tp"),
        F.count_if(known & flagged & (a == 0)).alias("fp"),
        F.count_if(known & ~flagged & (a == 1)).alias("fn"),
        F.count_if(known & ~flagged & (a == 0)).alias("tn"),
    ]


def with_window_rates(windows: DataFrame) -> DataFrame:
    """Recall and precision where labels exist; label counts are null in windows without any."""
    labelled = F.col("n_labeled") > 0
    rate = lambda other: F.when(labelled, F.col("tp") / F.greatest(F.col("tp") + F.col(other), F.lit(1)))
    out = windows.withColumns({"recall_event": rate("fn"), "precision_event": rate("fp")})
    return out.withColumns({c: F.when(labelled, F.col(c)) for c in ("tp", "fp", "fn", "tn")})


def performance_by_window(
    df: DataFrame, window: str, score: str, actual: str | None, threshold: float, digits: int | None = None
) -> DataFrame:
    """Score distribution per window and, over its labelled rows, the quality of the predictions."""
    if actual is None or actual not in df.columns:
        actual = "_actual"
        df = df.withColumn(actual, F.lit(None).cast("int"))
    found = with_window_rates(df.groupBy(window).agg(*window_aggregates(threshold, score, actual)))
    areas = curve_areas(score_curve(df, score, actual, [window], digits), [window]).select(window, "roc_auc")
    return found.join(areas, found[window].eqNullSafe(areas[window]), "left").select(found["*"], "roc_auc")


def score_summary(reference: DataFrame, production: DataFrame, score: str) -> DataFrame:
    """Mean, median and upper percentiles of the score on both sides."""
    both = reference.select(F.lit("reference").alias("side"), F.col(score).alias("score")).unionByName(
        production.select(F.lit("production").alias("side"), F.col(score).alias("score"))
    )
    q = exact_quantiles(both, ["score"], [0.5, 0.75, 0.9, 0.95], ["side"])
    mean = both.groupBy("side").agg(F.avg("score").alias("mean"))
    return mean.join(q, "side").select(
        "side", "mean", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("median", "p75", "p90", "p95"))]
    )


def drifting_columns(report: DataFrame, top: int = 6) -> list[str]:
    """The columns that need a closer look, worst first."""
    calm = K.PSI_LABELS[0]
    rows = report.where(F.col("status") != calm).orderBy(F.col("psi").desc(), "name").limit(top).collect()
    return [r["name"] for r in rows]


def drift_histograms(reference: DataFrame, production: DataFrame, columns: Sequence[str], bins: int = 25) -> DataFrame:
    """Histograms of the listed columns on both sides, each over its own range."""
    if not columns:
        raise ValueError("no drifting column to show")
    ref = reference.select(F.lit("reference").alias("side"), *[F.col(c).cast("double").alias(c) for c in columns])
    prod = production.select(F.lit("production").alias("side"), *[F.col(c).cast("double").alias(c) for c in columns])
    return histogram(ref.unionByName(prod), list(columns), bins, ["side"])


def drift_summary(report: DataFrame, score_psi: float, alert_at: float = K.PSI_MONITOR_BELOW) -> DataFrame:
    """Columns per status and the overall status, which follows the score's own index."""
    calm, watch, drift = K.PSI_LABELS
    count = lambda s: F.count_if(F.col("status") == s)
    overall = F.when(F.lit(score_psi) > alert_at, K.PSI_ALERT).when(F.lit(score_psi) > alert_at / 2, watch)
    overall = overall.otherwise(calm)
    return report.agg(
        count(drift).alias("n_drift"), count(watch).alias("n_monitor"), count(calm).alias("n_stable")
    ).withColumns({"psi_score": F.lit(float(score_psi)), "status": overall})


def monitoring_summary(
    report: DataFrame, score_psi: float, reference: DataFrame, production: DataFrame, use_case: str, event: str, model: str,
    alert_at: float = K.PSI_MONITOR_BELOW,
) -> DataFrame:
    """The stored record of one monitoring run: what was compared, how many rows on each side, the score's index with its
    threshold, columns per status, and the overall status."""
    rows = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    found = drift_summary(report, score_psi, alert_at).withColumns({
        "use_case": F.lit(use_case), "event_col": F.lit(event), "model_name": F.lit(model), "psi_threshold": F.lit(float(alert_at))})
    # Three tables of one row each.
    one = F.lit(1)
    joined = found.withColumn("_one", one).join(rows(reference, "n_reference").withColumn("_one", one), "_one").join(
        rows(production, "n_production").withColumn("_one", one), "_one")
    return joined.select("use_case", "event_col", "model_name", "psi_score", "psi_threshold", "n_drift", "n_monitor", "n_stable",
                         "n_reference", "n_production", "status")


def enough_rows(df: DataFrame, minimum: int = K.MONITOR_MIN_ROWS) -> bool:
    """Whether there are enough production rows; only that many are looked at."""
    found = df.limit(minimum).count()
    if found < minimum:
        log.warning("only %d production rows, %d wanted; results may not be representative", found, minimum)
    return found >= minimum
