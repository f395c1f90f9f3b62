"""Exact quantiles without holding a column's values in one task.

A quantile sketch, merged map-side, brackets every wanted order statistic. A second pass counts
the values inside the brackets and collapses everything between them to one count per gap. Only
the few distinct bracketed values are ordered. When the brackets would still hold too many rows,
they are narrowed by further passes of the same kind. Each pass counts a bracket's two end values
apart from its inside, so that a value held by a large share of the rows ends up as an end value
and cannot keep a bracket wide.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.sources.workspace import settle_local

GRID_STEPS = 500
SKETCH_ACCURACY = 5_000
WINDOW_ROWS = 2_000_000


def names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def unpivot_numbers(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), keep_nulls: bool = False
) -> DataFrame:
    """``(by..., name, value)`` with one row per present number, or per row with ``keep_nulls``."""
    numbers = [f"nanvl(try_cast(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS `{c}`" for c in columns]
    long = df.selectExpr(*[f"`{c}`" for c in by], *numbers).unpivot(list(by), list(columns), "name", "value")
    return long if keep_nulls else long.where("value IS NOT NULL")


def _place(long: DataFrame, brackets: DataFrame | None, group: Sequence[str], most: int) -> DataFrame:
    """Add the first of up to ``most`` brackets not entirely below the value, and where it lies in it.

    ``part`` is 0 below the bracket, 1 on its low end, 2 strictly inside, 3 on its high end.
    """
    if brackets is None:
        return long.selectExpr("*", "0 AS slot", "2 AS part")
    on = " AND ".join(f"l.`{c}` <=> b.`{c}`" for c in group)
    joined = long.alias("l").join(brackets.alias("b"), F.expr(on))
    cols = [f"`{c}`" for c in group]
    # Written out rather than as a lambda over the array, so that it compiles with the scan.
    passed = " + ".join(f"IF(get(highs, {i}) < value, 1, 0)" for i in range(most))
    return (
        joined.selectExpr(*[f"l.`{c}`" for c in group], "value", f"{passed} AS slot", "lows", "highs")
        .selectExpr(*cols, "value", "slot", "get(lows, slot) AS low", "get(highs, slot) AS high")
        .selectExpr(
            *cols, "value", "slot",
            "CASE WHEN value = low THEN 1 WHEN value = high THEN 3 WHEN value > low THEN 2 ELSE 0 END AS part",
        )
    )


def _positions(probs: Sequence[float]) -> str:
    """0-based, fractional positions of the quantiles among ``total`` sorted values."""
    return "array(" + ", ".join(f"{float(p)!r}D * (total - 1)" for p in probs) + ")"


def _brackets(placed: DataFrame, probs: Sequence[float], group: Sequence[str]) -> DataFrame:
    """One row per group: sorted brackets that together hold every wanted order statistic."""
    # One constant instead of hundreds of literal nodes keeps the plan short.
    grid = ",".join(str(i / GRID_STEPS) for i in range(GRID_STEPS + 1))
    by, cols = names(group), [f"`{c}`" for c in group]
    pieces = placed.groupBy(*group, "slot", "part").agg(
        F.expr("count(1) AS rows"),
        F.expr("min(value) AS least"),
        F.expr(
            f"percentile_approx(CASE WHEN part = 2 THEN value END, "
            f"cast(split('{grid}', ',') AS ARRAY<DOUBLE>), {SKETCH_ACCURACY}) AS grid"
        ),
    )
    g = GRID_STEPS
    ranks = f"transform({_positions(probs)}, p -> floor(p))"
    return (
        pieces.selectExpr(
            "*",
            f"sum(rows) OVER (PARTITION BY {by} ORDER BY slot, part) - rows AS before",
            f"sum(rows) OVER (PARTITION BY {by}) AS total",
        )
        .selectExpr(
            *cols, "part", "rows", "least", "grid", "before",
            f"explode(array_distinct(concat({ranks}, transform({ranks}, r -> least(r + 1, total - 1))))) AS rank",
        )
        .where("before <= rank AND rank < before + rows")
        .selectExpr(
            *cols, "part", "rows", "least", "grid",
            f"CAST(greatest(floor((rank - before) * {g}D / rows) - 1, 0) AS INT) AS first",
            f"CAST(least(ceil((rank - before + 1) * {g}D / rows) + 1, {g}) AS INT) AS last",
        )
        .selectExpr(
            *cols,
            "IF(part = 2, get(grid, first), least) AS low", "IF(part = 2, get(grid, last), least) AS high",
            f"IF(part = 2, (last - first) * rows / {g}D, 0D) AS span",
        )
        .groupBy(*group)
        .agg(F.expr("array_sort(collect_set(struct(low, high))) AS b"), F.expr("sum(span) AS span"))
        .selectExpr(*cols, "transform(b, x -> x.low) AS lows", "transform(b, x -> x.high) AS highs", "span")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """``(by..., name, n, quantiles, lower)`` for each numeric column, nulls left out.

    ``quantiles[i]`` interpolates linearly between neighbours; ``lower[i]`` is the lower neighbour.
    ``probs`` must ascend.
    """
    group = [*by, "name"]
    part, cols = names(group), [f"`{c}`" for c in group]
    long = unpivot_numbers(df, columns, by)
    most = 2 * len(probs)
    brackets, widest, previous = None, float("inf"), None
    # A pass divides the rows between bracket ends by over a hundred; only a handful of rows per
    # bracket, less than any sensible window, no longer shrinks.
    while widest > window_rows and (previous is None or widest < previous):
        previous = widest if brackets is not None else None
        brackets, local = settle_local(_brackets(_place(long, brackets, group, most), probs, group))
        if local is not None:
            widest = pc.max(local["span"]).as_py() or 0
        else:
            widest = brackets.agg(F.max("span")).first()[0]
    cells = (
        _place(long, brackets, group, most)
        .selectExpr(*cols, "slot", "CASE WHEN part > 0 THEN value END AS cell")
        .groupBy(*group, "slot", "cell")
        .agg(F.expr("count(1) AS rows"))
    )
    in_base = "before <= base AND base < before + rows"
    in_next = "before <= above AND above < before + rows"
    picked = (
        cells.selectExpr(
            *cols, "cell", "rows",
            f"sum(rows) OVER (PARTITION BY {part} ORDER BY slot, cell NULLS FIRST) - rows AS before",
            f"sum(rows) OVER (PARTITION BY {part}) AS total",
        )
        .selectExpr("*", f"posexplode({_positions(probs)}) AS (item, position)")
        .selectExpr("*", "floor(position) AS base", "least(floor(position) + 1, total - 1) AS above")
        .where(f"({in_base}) OR ({in_next})")
        .groupBy(*group, "item")
        .agg(
            F.expr("max(total) AS n"),
            F.expr("max(position - base) AS part"),
            F.expr(f"max(CASE WHEN {in_base} THEN cell END) AS a"),
            F.expr(f"max(CASE WHEN {in_next} THEN cell END) AS b"),
        )
    )
    checked = "coalesce(a, raise_error('order statistic outside its bracket'))"
    # Measured from the nearer neighbour, as numpy does: exact at both ends of the gap.
    between = f"IF(part < 0.5D, {checked} + (b - a) * part, b - (b - a) * (1 - part))"
    return (
        picked.groupBy(*group)
        .agg(
            F.expr("max(n) AS n"),
            F.expr(f"array_sort(collect_list(struct(item, {between} AS q, a))) AS s"),
        )
        .selectExpr(*cols, "n", "transform(s, x -> x.q) AS quantiles", "transform(s, x -> x.a) AS lower")
    )


def collected_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], lower: bool = False
) -> dict[str, list[float]]:
    """Ungrouped quantiles on the driver: one short list per column that holds any number."""
    field = "lower" if lower else "quantiles"
    return {r["name"]: list(r[field]) for r in exact_quantiles(df, columns, probs).collect()}


def even_probs(parts: int) -> list[float]:
    """Evenly spaced shares, rounded as pandas and numpy do when they pass them on as percentages."""
    step = 1.0 / parts
    return [i * step * 100 / 100 for i in range(parts)] + [1.0]
