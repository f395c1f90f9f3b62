"""Exploratory tables: summaries, data quality, target rates over time, histograms, densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.functions import constants as K
from lendscope.functions.expressions import month_key, weekday_name
from lendscope.operators.quantiles import collected_quantiles, even_probs, exact_quantiles, unpivot_numbers
from lendscope.sources.workspace import settle

MARGIN = "All"


def _match(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    return [left[c].eqNullSafe(right[c]) for c in columns]


def column_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample spread, extremes and exact quartiles per column, and per group if given."""
    group = [*by, "name"]
    basics = unpivot_numbers(df, columns, by).groupBy(*group).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarts = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by).select(
        *group, *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))]
    )
    return basics.join(quarts, _match(basics, quarts, group)).select(
        basics["*"], quarts["q25"], quarts["q50"], quarts["q75"]
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column; nulls equal each other."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # whatever the columns are called
    copies = plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls, their number and percentage, worst first."""
    row = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    counted = df.agg(*row)
    long = counted.unpivot(["rows"], list(df.columns), "name", "nulls")
    return (
        long.where("nulls > 0")
        .select("name", "nulls", (100 * F.col("nulls") / F.col("rows")).alias("pct"))
        .orderBy(F.col("pct").desc(), "name")
    )


def category_quality(df: DataFrame, column: str, valid: Sequence[str]) -> DataFrame:
    known = F.col(column).isin(list(valid))
    return df.agg(
        F.count_if(known).alias("n_valid"),
        F.count_if(F.col(column).isNotNull() & ~known).alias("n_dirty"),
        F.count_if(F.col(column).isNull()).alias("n_null"),
    )


def top_dirty(df: DataFrame, column: str, valid: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values outside the catalogue."""
    dirty = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(valid)))
    counts = dirty.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(k)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def share_at_max(df: DataFrame, column: str, event: str) -> DataFrame:
    """Share of non-events sitting exactly on the column's overall maximum."""
    top = df.agg(F.max(column)).first()[0]
    at_top = F.coalesce(F.col(column) == F.lit(top), F.lit(False)).cast("double")
    return df.where(F.col(event) == 0).agg(F.avg(at_top).alias("share_at_max"))


def monthly_rate(df: DataFrame, date_col: str, event: str) -> DataFrame:
    """Volume and event rate per month, with the centred mean of three listed months."""
    monthly = (
        df.where(F.col(date_col).isNotNull())
        .groupBy(month_key(F.col(date_col)).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(event).alias("event_rate"))
    )
    around = W.orderBy("month").rowsBetween(-1, 1)
    smooth = F.when(F.count("event_rate").over(around) == 3, F.avg("event_rate").over(around))
    return monthly.withColumn("rolling3", smooth)


def weekday_rate(df: DataFrame, date_col: str, event: str) -> DataFrame:
    """Volume and event rate for the seven weekdays in order; a weekday without rows gives nulls."""
    spark = df.sparkSession
    days = spark.createDataFrame([(i, d) for i, d in enumerate(K.WEEKDAYS, 1)], "day int, weekday string")
    found = df.groupBy(weekday_name(F.col(date_col)).alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(event).alias("event_rate")
    )
    # At most seven rows on either side.
    return days.join(F.broadcast(found), "weekday", "left").select("day", "weekday", "n", "event_rate").orderBy("day")


def category_frequencies(df: DataFrame, column: str) -> DataFrame:
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "value")


def _texts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., name, value)`` with one row per present value, as text."""
    texts = df.select(*keep, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return texts.unpivot(list(keep), list(columns), "name", "value").where(F.col("value").isNotNull())


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``category_frequencies`` of many columns in one pass, most frequent first within each."""
    counts = _texts(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("name", F.col("n").desc(), "value")


def _ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    long = unpivot_numbers(df, columns, by)
    ranges = long.groupBy(*by, "name").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("total"),
        F.stddev_samp("value").alias("std"),
    )
    return long, settle(ranges)


def equal_width_place(value: str, lo: str, width: str, bins: int):
    """0-based equal-width bin of a value inside the range, the last bin closed.

    The quotient may round across an edge; comparing with the edges themselves settles the bin.
    """
    guess = f"least(floor(({value} - {lo}) / {width}), {bins - 1})"
    return F.expr(
        f"{guess} - IF({value} < {lo} + {guess} * {width}, 1, 0)"
        f" + IF({guess} < {bins - 1} AND {value} >= {lo} + ({guess} + 1) * {width}, 1, 0)"
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins per column over its own range, and per group over the group's own range.

    Every bin is listed, empty ones with 0. The last bin is closed. A constant column spans one
    unit around its value. ``density`` integrates to 1.
    """
    group = [*by, "name"]
    long, ranges = _ranges(df, columns, by)
    spans = ranges.select(
        *group, "total",
        F.expr("CASE WHEN lo = hi THEN lo - 0.5D ELSE lo END AS lo"),
        F.expr("CASE WHEN lo = hi THEN hi + 0.5D ELSE hi END AS hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    located = long.join(spans, _match(long, spans, group)).select(
        *[long[c] for c in group], equal_width_place("value", "lo", "width", bins).alias("bin"))
    counts = located.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    full = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    found = full.join(counts, _match(full, counts, [*group, "bin"]), "left")
    n = F.coalesce(counts["n"], F.lit(0))
    return found.select(
        *[full[c] for c in group], full["bin"],
        (F.col("lo") + F.col("width") * full["bin"]).alias("bin_lo"),
        (F.col("lo") + F.col("width") * (full["bin"] + 1)).alias("bin_hi"),
        n.alias("n"), (n / (F.col("total") * F.col("width"))).alias("density"),
    )


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and number of points beyond them."""
    group = [*by, "name"]
    quarts = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by).select(
        *group, *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))]
    )
    iqr = F.col("q3") - F.col("q1")
    fences = settle(quarts.withColumns({
        "low_fence": F.col("q1") - K.IQR_REACH * iqr, "high_fence": F.col("q3") + K.IQR_REACH * iqr,
    }))
    long = unpivot_numbers(df, columns, by)
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    joined = long.join(fences, _match(long, fences, group)).select(
        *[long[c] for c in group], "value", "q1", "median", "q3", "low_fence", "high_fence"
    )
    return joined.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_beyond"),
    )


def kde(
    df: DataFrame, column: str, by: Sequence[str] = (), points: int = 200, bins: int | None = 2048, cut: float = 3.0
) -> DataFrame:
    """Gaussian density curve with Scott's bandwidth on an even grid, per group if given.

    Values are first counted in ``bins`` equal cells, each taken at the mean of its values, so that
    the work per grid point is bounded. ``bins=None`` uses every distinct value instead.
    """
    group = [*by, "name"]
    long, ranges = _ranges(df, [column], by)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins or 1))
    spans = ranges.where("std > 0").select(
        *group, "lo", "hi", "total", width.alias("width"),
        (F.col("std") * F.pow(F.col("total"), F.lit(-0.2))).alias("h"),
    )
    joined = long.join(spans, _match(long, spans, group)).select(
        *[long[c] for c in group], "value", "lo", "hi", "total", "width", "h"
    )
    if bins:
        cell = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1).cast("long"))
    else:
        cell = F.col("value")
    stats = [*group, "lo", "hi", "total", "width", "h"]
    cells = joined.withColumn("cell", cell).groupBy(*stats, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    start = F.col("lo") - cut * F.col("h")
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)
    spread = cells.select(
        *group, "total", "h", "n", "m", start.alias("start"), step.alias("step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    ).withColumn("x", F.col("start") + F.col("step") * F.col("point"))
    z = (F.col("x") - F.col("m")) / F.col("h")
    return spread.groupBy(*group, "point").agg(
        F.first("x").alias("x"),
        (F.sum(F.col("n") * F.exp(-0.5 * z * z)) / F.first(F.col("total") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
         ).alias("density"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values strictly outside the 1.5 IQR fences; the percentage is over all rows."""
    quarts = collected_quantiles(df, columns, [0.25, 0.75])
    rows, counts = [], [F.count(F.lit(1)).alias("rows")]
    for c, (q1, q3) in quarts.items():
        low, high = q1 - K.IQR_REACH * (q3 - q1), q3 + K.IQR_REACH * (q3 - q1)
        rows.append((c, q1, q3, low, high))
        counts.append(F.count_if((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))).alias(c))
    found = df.agg(*counts).unpivot(["rows"], list(quarts), "name", "n_outliers")
    fences = df.sparkSession.createDataFrame(rows, "name string, q1 double, q3 double, low double, high double")
    return found.join(F.broadcast(fences), "name").select(
        "name", "q1", "q3", "low", "high", "n_outliers", (100 * F.col("n_outliers") / F.col("rows")).alias("pct")
    ).orderBy(F.col("pct").desc(), "name")


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Counts of every pair with margins named ``All``; pairs with a null are left out."""
    cube = (
        df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
        .cube(F.col(rows).alias("r"), F.col(cols).alias("c"))
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    )
    return cube.select(
        F.when(F.col("level").bitwiseAND(2) == 2, MARGIN).otherwise(F.col("r").cast("string")).alias(rows),
        F.when(F.col("level").bitwiseAND(1) == 1, MARGIN).otherwise(F.col("c").cast("string")).alias(cols),
        "n",
    )


def rate_by_category(df: DataFrame, column: str, event: str) -> DataFrame:
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(event) * 100).alias("event_pct")
    ).orderBy(F.col("event_pct").desc(), "value")


def rates_by_category(df: DataFrame, columns: Sequence[str], event: str) -> DataFrame:
    """``rate_by_category`` of many columns in one pass, highest rate first within each."""
    rows = _texts(df.withColumn("_event", F.col(f"`{event}`")), columns, ["_event"])
    return rows.groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_event") * 100).alias("event_pct")
    ).orderBy("name", F.col("event_pct").desc(), "value")


def quantile_edges(df: DataFrame, columns: Sequence[str], parts: int = 10) -> dict[str, list[float]]:
    """Distinct quantile edges per column; equal edges merge."""
    found = collected_quantiles(df, columns, even_probs(parts))
    return {c: sorted(set(edges)) for c, edges in found.items()}


def quantile_bins(df: DataFrame, edges: dict[str, list[float]], keep: str) -> DataFrame:
    """``(keep, name, bin)``: the quantile bin of every present value, all columns in one pass."""
    table = df.sparkSession.createDataFrame(list(edges.items()), "name string, edges array<double>")
    most = max((len(e) for e in edges.values()), default=0)
    passed = " + ".join(["0", *[f"IF(get(edges, {i}) < value, 1, 0)" for i in range(most)]])
    long = unpivot_numbers(df, list(edges), [keep])  # one edge row per listed column
    return long.join(F.broadcast(table), "name").selectExpr(f"`{keep}`", "name", f"greatest(1, {passed}) AS bin")


def rate_by_quantile(df: DataFrame, columns: Sequence[str], event: str, parts: int = 10) -> DataFrame:
    """Event rate per quantile bin of each column, with the bin's edges."""
    edges = quantile_edges(df, columns, parts)
    rates = quantile_bins(df, edges, event).groupBy("name", "bin").agg(
        F.avg(event).alias("event_rate"), F.count(F.lit(1)).alias("n")
    )
    rows = [(c, i, lo, hi) for c, e in edges.items() for i, (lo, hi) in enumerate(zip(e, e[1:] or e), 1)]
    table = df.sparkSession.createDataFrame(rows, "name string, bin int, lo double, hi double")
    return rates.join(F.broadcast(table), ["name", "bin"], "left")
