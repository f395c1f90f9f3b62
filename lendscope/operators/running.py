"""Running totals over a global order, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.functions.expressions import as_number
from lendscope.sources.workspace import ensure_checkpoint_dir, settle

WINDOW_ROWS = 1_000_000


def running_totals(
    counts: DataFrame,
    value: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    levels: int | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``cum_<c>``, the sum over rows up to and including this value, and ``total_<c>``, per group.

    ``counts`` holds one row per group and value. With ``levels``, a proven bound on the values per
    group, up to ``window_rows``, one window per group is used. Otherwise the number of rows is
    looked up first, and a larger table is cut into value ranges of even size, each summed on its
    own and shifted by the totals of the ranges before it. Rows without a value, or with NaN, are left out
    either way. The table is then written once to the shared folder, as it is read several times.
    """
    by = list(by)
    counts = counts.where(as_number(value).isNotNull())
    direction = F.col(value).desc() if descending else F.col(value).asc()
    if levels is not None and levels <= window_rows:
        return _whole(counts, direction, totals, by)
    ensure_checkpoint_dir(counts.sparkSession)
    counts = counts.checkpoint()
    rows = counts.count()
    if rows <= window_rows:
        return _whole(counts, direction, totals, by)
    # Cut points come from a sketch and are constants from here on: a recomputed task places its
    # rows as before. A range holds few more rows than the sketch promises.
    ranges = -(-rows // window_rows) * 2
    probs = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    inner = counts.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10 * ranges)).first()[0]
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_place", outputCol="_range").transform(
        counts.withColumn("_place", F.col(value).cast("double"))
    )
    sums = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in totals])
    group = W.partitionBy(*by)
    before = group.orderBy(F.col("_range").desc() if descending else F.col("_range").asc())
    offsets = settle(sums.select(
        *by, "_range",
        *[(F.sum(c).over(before) - F.col(c)).alias(f"_off_{c}") for c in totals],
        *[F.sum(c).over(group).alias(f"total_{c}") for c in totals],
    ))
    local = cut.select("*", *_cumulated(totals, direction, [*by, "_range"]))
    on = [local[c].eqNullSafe(offsets[c]) for c in [*by, "_range"]]
    return local.join(offsets, on).select(
        *[local[c] for c in counts.columns],
        *[(F.col(f"cum_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in totals],
        *[f"total_{c}" for c in totals],
    )


def _cumulated(totals: Sequence[str], direction, by: Sequence[str]) -> list:
    order = W.partitionBy(*by).orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    return [F.sum(c).over(order).alias(f"cum_{c}") for c in totals]


def _whole(counts: DataFrame, direction, totals: Sequence[str], by: Sequence[str]) -> DataFrame:
    group = W.partitionBy(*by)
    return counts.select(
        "*", *_cumulated(totals, direction, by), *[F.sum(c).over(group).alias(f"total_{c}") for c in totals]
    )
