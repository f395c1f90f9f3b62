"""One-hot encoding of columns with any number of categories: numbered in ranges, stored as a table, joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.sources.workspace import ensure_checkpoint_dir, settle

#: A category with more than one row in HEAVY is looked up by broadcast, so a column has fewer than HEAVY of them.
HEAVY = 1_000
SPARSE = T.StructType([T.StructField("v", VectorUDT())])
SLOTS = "v struct<size int, indices array<int>>"


def number_categories(counts: DataFrame) -> DataFrame:
    """``(name, key, n)`` with ``place``, the position of the key among the sorted keys of its name, and ``size``.

    Keys are dealt into ranges, numbered in each and shifted by the rows of the ranges before, so no task sorts a whole
    column. The ranges are checkpointed: a lost task finds the same keys again.
    """
    ensure_checkpoint_dir(counts.sparkSession)
    ranged = counts.repartitionByRange("name", "key").withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("name", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("name").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "name", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(W.partitionBy("name")).alias("size"))
    local = F.row_number().over(W.partitionBy("name", "_part").orderBy("key")) - 1
    placed = ranged.withColumn("_local", local).join(starts, ["name", "_part"])
    return placed.select("name", "key", "n", (F.col("_start") + F.col("_local")).cast("int").alias("place"), F.col("size").cast("int").alias("size"))


def sparse_vector(size: int, slot: Column) -> Column:
    """A vector of ``size`` zeros with 1 at ``slot``, or without any where the slot is null.

    Spark has no function for it; a vector's stored form passes through JSON inside the JVM.
    """
    indices = F.when(slot.isNull(), F.array().cast("array<int>")).otherwise(F.array(slot.cast("int")))
    values = F.when(slot.isNull(), F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
    stored = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(stored.alias("v"))), SPARSE)["v"]


def filled_slots(vector: str | Column) -> Column:
    """``(size, indices)`` of a sparse vector column."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.from_json(F.to_json(F.struct(column.alias("v"))), SLOTS)["v"]


def join_places(df: DataFrame, value: Column, categories: DataFrame, rows: int, out: str) -> DataFrame:
    """``df`` with ``out``, the place of ``value`` in ``categories`` (key, n, place); null where it is unknown.

    A value that fills more than one row in HEAVY of the ``rows`` that were counted is found by a broadcast of at most HEAVY
    such values. Only the others meet the large table, and rows already found are spread by a number, so no value gathers its rows in one task.
    """
    heavy = settle(categories.where(F.col("n") * HEAVY > rows).select(F.col("key").alias("_key"), F.col("place").alias("_heavy")))
    light = categories.where(F.col("n") * HEAVY <= rows).select(
        F.col("key").alias("_key"), F.lit(0).cast("long").alias("_spread"), F.col("place").alias("_light"))
    found = df.withColumn("_value", value).join(heavy, F.col("_value") == F.col("_key"), "left").drop("_key")
    known = F.col("_heavy").isNotNull() | F.col("_value").isNull()
    found = found.withColumns({
        "_value": F.when(~known, F.col("_value")),
        "_spread": F.when(known, F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")),
    })
    joined = found.join(light, (found["_value"] == light["_key"]) & (found["_spread"] == light["_spread"]), "left")
    return joined.select(*[found[f"`{c}`"] for c in df.columns], F.coalesce("_heavy", "_light").alias(out))


def wide_columns(counts: DataFrame, nominal: Sequence[str], most: int) -> list[str]:
    """The columns to encode as vectors: the widest ones, until the others hold at most ``most`` categories together."""
    sizes = {r["name"]: r["size"] for r in counts.where(F.col("name").isin(list(nominal))).groupBy("name").agg(
        F.count(F.lit(1)).alias("size")).collect()}
    wide, left = [], sum(sizes.values())
    for name in sorted(sizes, key=lambda c: -sizes[c]):
        if left <= most:
            break
        wide.append(name)
        left -= sizes[name]
    return wide
