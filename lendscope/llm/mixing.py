"""Mixing sources to target weights by weighted fair queueing, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import BLANK, full_text, saved
from lendscope.sources.workspace import settle

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows of one ordered range; ranges are summed on their own and shifted by the totals before them.
RANGE_ROWS = 5_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(full_text(text), F.lit(BLANK.replace("[", "[^") + "+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, rows, rank, target): ``weights`` repeat over the sources in code point order,
    null last. A target stops at ``most`` times the size of its source; the excess is shared by weight
    among the others until none is above.

    Sorted by size per weight, the sources that stop come first, so one pass of running sums
    over the table of sources settles all rounds of sharing. That table has one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    ranked = (ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
              .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))))
    ranked = ranked.withColumn("full", F.col("cap").cast("double") * F.col("open")
                               <= F.col("weight").cast("double") * (F.col("total") - F.col("before")))
    free_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(Window.partitionBy())
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(Window.partitionBy()), F.lit(0))
    share = F.try_divide((F.col("total") - spent).cast("double") * F.col("weight"), free_weight)
    return ranked.select("source", "source_size", "rows", "rank",
                         F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, range_rows: int = RANGE_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document with the words the mix takes of it, whole passes over the document counted.

    Each source is shuffled by a hash of the id. A document's virtual finish time is the running number of
    its source's words divided by the source's target, and a source that must repeat goes on
    with a second and a third pass. All passes form one global order by finish time, cut where the words reach
    the total of all sizes, so every source stands within one document of its target.

    Null text has size 0, a null source is a source of its own, a null id is shuffled as an empty one. Repeated
    rows count as documents of their own. Without words every target and every ``taken`` is 0. ``carry`` columns
    come back inside the struct ``row``.

    No source and no stretch of the order is summed in one task: hash ranges of about ``range_rows`` rows are summed
    apart and shifted, and finish times, which spread evenly by construction, are cut into ranges of which only the
    one holding the cut is put in order.
    """
    own = [F.col(f"`{c}`").alias(c) for c in carry]
    sizes = saved(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("shuffled"),
        *([F.struct(*own).alias("row")] if own else []),
    ), "sizes")
    targets = settle(source_targets(sizes, weights, most))
    placed = sizes.drop("row").join(targets, sizes.source.eqNullSafe(targets.source), "left").drop(targets.source)
    hashed = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.floor(hashed * F.ceil(F.col("rows") / range_rows) / (1 << 32)).cast("long"))

    totals = placed.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    start = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(totals.select("rank", "range", F.coalesce(F.sum("words").over(start), F.lit(0)).alias("start")))
    inside = Window.partitionBy("rank", "range").orderBy("shuffled", F.asc_nulls_last("doc_id"), "size", "row_no")
    queued = placed.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    queued = saved(queued.join(starts, ["rank", "range"]).select(
        "row_no", "doc_id", "size", "source_size", "target", "rank", (F.col("start") + F.col("inside")).alias("done"),
    ), "queued")

    passes = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.try_divide("target", "source_size")))).cast("int")
    turns = queued.filter("size > 0 AND target > 0").select(
        "rank", "size", "target", "source_size", "done", F.explode(F.sequence(F.lit(0), passes - 1)).alias("turn"))
    turns = turns.select("rank", "size", (F.col("turn") * F.col("source_size") + F.col("done")).alias("place"), "target")
    turns = turns.filter(F.col("place") - F.col("size") < F.col("target"))
    turns = turns.withColumn("finish", F.try_divide("place", "target"))
    cut = _cut(turns, sizes, range_rows)

    taken = F.lit(0).cast("long")
    if cut is not None:
        for turn in range(most):
            place = F.col("source_size") * turn + F.col("done")
            reached = F.struct(F.try_divide(place, F.col("target")).alias("finish"), F.col("rank"), place.alias("place"))
            end = F.struct(F.lit(cut.finish).alias("finish"), F.lit(cut.rank).alias("rank"), F.lit(cut.place).alias("place"))
            use = (F.col("size") > 0) & (F.col("target") > 0) & (passes > turn) & (place - F.col("size") < F.col("target")) & (reached <= end)
            taken = taken + F.when(use, F.col("size")).otherwise(F.lit(0))
    result = queued.select("row_no", "doc_id", "size", "source_size", "target", taken.alias("taken"))
    if not own:
        return result.drop("row_no")
    return result.join(sizes.select("row_no", "row"), "row_no").drop("row_no")


def _cut(turns: DataFrame, sizes: DataFrame, range_rows: int):
    """The last (finish, rank, place) of the global order within the total of all sizes; None without words."""
    stats = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    if not stats.words:
        return None
    ranges = max(1, -(-stats.rows // range_rows))
    binned = turns.withColumn("bin", F.floor(F.col("finish") * ranges).cast("long"))
    words = binned.groupBy("bin").agg(F.sum("size").alias("words"))
    running = words.withColumn("upto", F.sum("words").over(Window.orderBy("bin")))
    last = running.filter(F.col("upto") <= stats.words).agg(F.max("bin").alias("bin"), F.max("upto").alias("upto")).first()
    left = stats.words - (last.upto or 0)
    after = running.filter(F.col("upto") > stats.words).agg(F.min("bin").alias("bin")).first().bin
    order = [F.col("finish"), F.col("rank"), F.col("place")]
    whole = None if last.bin is None else binned.filter(F.col("bin") == last.bin).orderBy(*[c.desc() for c in order]).first()
    if after is None:
        return whole
    window = Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = (binned.filter(F.col("bin") == after).withColumn("sum", F.sum("size").over(window))
            .filter(F.col("sum") <= left).orderBy(*[c.desc() for c in order]).first())
    return part or whole


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns, each as often as the mix passes over it."""
    result = mix(docs, carry=docs.columns, **options).filter("taken > 0")
    times = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return result.select("row", times.alias("turn")).select("row.*")
