"""Keyed state: the keys stored so far, kept outside the table they were written to."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # A commit uploads the changes of its batch, not the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What a row of the marked stream is: an arriving row, a key seen for the first time, or a key stored before the stream began.
KIND, ROW, NEW, KNOWN = "_kind", "row", "new", "known"


@contextmanager
def keyed_state(spark: SparkSession):
    """Settings for queries started inside: state on the executors' disks, logged to the checkpoint folder."""
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def sort_key(value):
    """A Python key that orders values as Spark does: null first, NaN last, nested values field by field."""
    if value is None:
        return (0,)
    if isinstance(value, float):
        return (1, math.isnan(value), 0.0 if math.isnan(value) else value)
    if isinstance(value, str):
        return (1, value.encode("utf-8", "surrogatepass"))
    if isinstance(value, (list, tuple)):
        return (1, tuple(sort_key(v) for v in value))
    return (1, bytes(value) if isinstance(value, bytearray) else value)


def marked_rows(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """A stream of all ``rows``, and beside them one row per key that was never seen before and one per ``known`` key.

    ``known`` is a stream of the keys stored before this one began; all of it belongs to the first batch. Start the query
    inside :func:`keyed_state`. A batch looks up its own keys, whatever the number of stored ones, and
    :func:`first_of_batch` makes its result of it.
    """
    known = known.select(f"`{key}`").where(f"`{key}` IS NOT NULL")
    keys = rows.select(f"`{key}`").where(f"`{key}` IS NOT NULL").unionByName(known).dropDuplicates([key])
    every = rows.withColumn(KIND, F.lit(ROW))
    for found, kind in ((keys, NEW), (known, KNOWN)):
        every = every.unionByName(found.withColumn(KIND, F.lit(kind)), allowMissingColumns=True)
    return every


def first_of_batch(batch: DataFrame, key: str, date: str) -> DataFrame:
    """The rows to store of one batch of :func:`marked_rows`: one per new key, and all rows without a key.

    Of several rows that arrive together the earliest by ``date`` stays, undated rows last; rows of one date are
    told apart by their other columns. One pass, as reading a batch twice would update the state twice; rows without a key are
    groups of their own, spread like keys.
    """
    columns = [c for c in batch.columns if c != KIND]
    name = lambda c: F.col(f"`{c}`")
    rest = [c for c in columns if c not in (key, date)]
    row = F.struct(name(date).isNull().alias("_undated"), *map(name, dict.fromkeys([date, *rest])))
    unordered = {c for c, kind in batch.dtypes if "map<" in kind or "variant" in kind}
    held = F.when(F.col(KIND) == ROW, row)
    first = F.min(held) if not unordered else F.min_by(held, F.when(F.col(KIND) == ROW, F.struct(
        name(date).isNull(), *[name(c) for c in dict.fromkeys([date, *rest]) if c not in unordered])))
    lone = F.when(name(key).isNull(), F.monotonically_increasing_id()).alias("_lone")
    groups = batch.groupBy(name(key), lone).agg(
        first.alias("_row"), *[F.bool_or(F.col(KIND) == kind).alias(f"_{kind}") for kind in (NEW, KNOWN)])
    kept = groups.where(name(key).isNull() | (F.col(f"_{NEW}") & ~F.col(f"_{KNOWN}")))
    return kept.select(*[name(c) if c == key else F.col(f"_row.`{c}`") for c in columns])
