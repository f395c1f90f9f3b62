"""Correlation, significance tests and weight of evidence against a 0/1 event."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions import constants as K
from lendscope.functions.expressions import iv_power, significance
from lendscope.functions.tails import chi2_upper, student_t_two_sided
from lendscope.operators.profile import quantile_bins, quantile_edges
from lendscope.operators.quantiles import unpivot_numbers
from lendscope.sources.workspace import settle

#: Columns of a block; a pass over two blocks folds each task into a square matrix of six times as many rows.
BLOCK, SHIFT_ROWS = 150, 1_000


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for each pair, over the rows where both are present; null where one of them does not vary.

    One pass: each task folds its rows into a matrix of pairwise counts, sums and products, and the matrices are merged in a
    tree. Only beyond BLOCK columns are there several passes, one per pair of blocks.
    """
    return _correlations(df, columns, list(combinations(columns, 2)))


def _correlations(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    numbers = df.selectExpr(*[f"nanvl(try_cast(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS `{c}`" for c in columns])
    place = {c: i // BLOCK for i, c in enumerate(columns)}
    together: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for a, b in pairs:
        together.setdefault((min(place[a], place[b]), max(place[a], place[b])), []).append((a, b))
    # A pair of two blocks is covered by the pass over both, which then needs no pass over either alone.
    for one in [k for k in together if k[0] == k[1]]:
        wider = next((k for k in together if one[0] in k and k != one), None)
        if wider:
            together[wider] += together.pop(one)
    rows: list[tuple] = []
    for blocks, wanted in together.items():
        used = [c for c in columns if place[c] in blocks]
        found = _pairwise(numbers.select(*[F.col(f"`{c}`") for c in used]), used)
        at = {c: i for i, c in enumerate(used)}
        rows += [(a, b, None if np.isnan(r := found[at[a], at[b]]) else float(r)) for a, b in wanted]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def _pairwise(numbers: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlation matrix over pairwise complete rows, NaN where undefined.

    A row becomes the vector (values, squares, presence), with zeros for what is missing and values counted from one
    present value of their column, which keeps the products small. The products of these vectors with themselves, summed
    over all rows, hold every pair's count, sums, squares and product.
    """
    sample = numbers.limit(SHIFT_ROWS).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    shift = F.array(*[F.lit(sample[i] or 0.0) for i in range(len(columns))])
    values = F.zip_with(F.array(*[F.col(f"`{c}`") for c in columns]), shift, lambda x, s: x - s)
    arrays = numbers.select(values.alias("x"))
    zero = lambda of: F.transform("x", lambda x: F.coalesce(of(x), F.lit(0.0)))
    vectors = arrays.select(array_to_vector(F.concat(
        zero(lambda x: x), zero(lambda x: x * x), F.transform("x", lambda x: x.isNotNull().cast("double")))).alias("v"))
    if vectors.isEmpty():
        return np.full((len(columns), len(columns)), np.nan)
    products = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    k = len(columns)
    part = lambda i, j: products[i * k:(i + 1) * k, j * k:(j + 1) * k]
    n, sums, squares, both = part(2, 2), part(0, 2), part(1, 2), part(0, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - sums * sums / n
        spread[spread <= 1e-13 * squares] = np.nan  # a column that does not vary over the pair's rows
        return (both - sums * sums.T / n) / np.sqrt(spread * spread.T)


def correlation_ranking(df: DataFrame, columns: Sequence[str], event: str) -> DataFrame:
    found = _correlations(df, [*columns, event], [(c, event) for c in columns])
    return found.selectExpr("a AS name", "corr").orderBy(F.abs("corr").desc(), "name")


def welch_stats(df: DataFrame, columns: Sequence[str], event: str) -> DataFrame:
    """Means per class, Welch's t (non-events minus events) and its degrees of freedom."""
    long = unpivot_numbers(df, columns, [event])
    side = lambda agg, flag: agg(F.when(F.col(event) == flag, F.col("value")))
    sides = long.groupBy("name").agg(
        side(F.avg, 0).alias("mean0"), side(F.avg, 1).alias("mean1"),
        (side(F.var_samp, 0) / F.nullif(side(F.count, 0), F.lit(0))).alias("e0"),
        (side(F.var_samp, 1) / F.nullif(side(F.count, 1), F.lit(0))).alias("e1"),
        side(F.count, 0).alias("n0"), side(F.count, 1).alias("n1"),
    )
    return sides.selectExpr(
        "name", "mean0", "mean1",
        "(mean0 - mean1) / nullif(sqrt(e0 + e1), 0) AS t_stat",
        "(e0 + e1) * (e0 + e1) / nullif(e0 * e0 / nullif(n0 - 1, 0) + e1 * e1 / nullif(n1 - 1, 0), 0) AS df",
    )


def welch_test(df: DataFrame, columns: Sequence[str], event: str) -> DataFrame:
    """``welch_stats`` with two-sided p-values; one row per column crosses the driver."""
    rows = [
        (r["name"], r["mean0"], r["mean1"], r["t_stat"], r["df"], student_t_two_sided(r["t_stat"], r["df"]))
        for r in welch_stats(df, columns, event).collect()
    ]
    table = df.sparkSession.createDataFrame(
        rows, "name string, mean0 double, mean1 double, t_stat double, df double, p_value double"
    )
    return table.withColumn("significance", significance(F.col("p_value"))).orderBy("p_value", "name")


def chi2_stats(df: DataFrame, columns: Sequence[str], event: str) -> DataFrame:
    """Chi-square of independence per category column; 2×2 tables get the continuity correction."""
    texts = df.select(F.col(event).alias("_event"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot(["_event"], list(columns), "name", "category").where(
        F.col("category").isNotNull() & F.col("_event").isNotNull()
    )
    cells = long.groupBy("name", "category").agg(
        F.count_if(F.col("_event") == 0).alias("o0"), F.count_if(F.col("_event") != 0).alias("o1")
    )
    cells = settle(cells)
    totals = cells.groupBy("name").agg(
        F.sum("o0").alias("t0"), F.sum("o1").alias("t1"), F.count(F.lit(1)).alias("categories")
    )
    joined = cells.join(F.broadcast(totals), "name")  # one row per listed column

    def term(o: str, t: str):
        expected = (F.col("o0") + F.col("o1")) * F.col(t) / (F.col("t0") + F.col("t1"))
        gap = F.abs(F.col(o) - expected)
        gap = F.when(F.col("categories") == 2, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return gap * gap / F.nullif(expected, F.lit(0.0))

    return joined.groupBy("name").agg(
        F.sum(term("o0", "t0") + term("o1", "t1")).alias("chi2"),
        (F.max("categories") - 1).alias("df"),
    )


def chi2_test(df: DataFrame, columns: Sequence[str], event: str) -> DataFrame:
    rows = [
        (r["name"], r["chi2"], r["df"], chi2_upper(r["chi2"], r["df"]))
        for r in chi2_stats(df, columns, event).collect()
    ]
    table = df.sparkSession.createDataFrame(rows, "name string, chi2 double, df long, p_value double")
    return table.withColumn("significance", significance(F.col("p_value")))


def woe_bins(
    df: DataFrame, numeric: Sequence[str], event: str, categories: Sequence[str] = (), parts: int = 10
) -> DataFrame:
    """Weight of evidence per bin: quantile bins for numbers, the value itself for text."""
    pieces = []
    if numeric:
        edges = quantile_edges(df, numeric, parts)
        pieces.append(quantile_bins(df, edges, event).withColumn("bin", F.col("bin").cast("string")))
    if categories:
        texts = df.select(event, *[F.col(c).cast("string").alias(c) for c in categories])
        pieces.append(texts.unpivot([event], list(categories), "name", "bin").where(F.col("bin").isNotNull()))
    # Counted before the union, so that only bins leave the scan.
    counted = [
        p.groupBy("name", "bin").agg(F.count(F.lit(1)).alias("total"), F.sum(event).alias("events")) for p in pieces
    ]
    bins = reduce(DataFrame.unionByName, counted)
    # One row per listed column: safe to broadcast whatever the number of bins.
    totals = bins.groupBy("name").agg(
        F.sum("events").alias("all_ev"), F.sum(F.col("total") - F.col("events")).alias("all_nev")
    )
    bins = bins.join(F.broadcast(totals), "name").selectExpr(
        "name", "bin", "total", "events", "total - events AS non_events",
        "events / CAST(nullif(all_ev, 0) AS DOUBLE) AS dist_ev",
        "(total - events) / CAST(nullif(all_nev, 0) AS DOUBLE) AS dist_nev",
    )
    eps = F.lit(K.WOE_EPSILON)
    bins = bins.withColumn("woe", F.ln((F.col("dist_ev") + eps) / (F.col("dist_nev") + eps)))
    return bins.withColumn("iv_bin", (F.col("dist_ev") - F.col("dist_nev")) * F.col("woe"))


def iv_ranking(bins: DataFrame) -> DataFrame:
    """Information value per column with its power label, strongest first."""
    total = bins.groupBy("name").agg(F.sum("iv_bin").alias("iv"))
    return total.withColumn("power", iv_power(F.col("iv"))).orderBy(F.col("iv").desc(), "name")
