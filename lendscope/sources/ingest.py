"""Incremental ingestion: predicate, quality gate, raw write and high-water mark."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions import constants as K
from lendscope.sources.readers import fetch, selected_columns
from lendscope.sources.sinks import merge_published, merge_slice, output_format, write_raw
from lendscope.sources.workspace import ensure_checkpoint_dir

log = logging.getLogger(__name__)


def since_value(since: str | None, saved: str | None, start: str | None, lookback_days: int = 0) -> str | None:
    """The first wanted key value: argument, else saved mark, else configured start, less the lookback."""
    value = since or saved or start
    if not value:
        return None
    try:
        return (datetime.fromisoformat(str(value)) - timedelta(days=lookback_days)).isoformat()
    except ValueError:
        return str(value)


def incremental_filter(df_or_key, value: str | None, key: str | None = None) -> Column | None:
    """``key >= value``, inclusive; None where there is no key or no value."""
    name = key or (df_or_key if isinstance(df_or_key, str) else None)
    if not name or value is None:
        return None
    if isinstance(df_or_key, DataFrame):
        kind = df_or_key.schema[name].dataType
        return F.col(name) >= F.lit(value).cast(kind)
    return F.col(name) >= F.lit(value)


def quality_counts(df: DataFrame, unique_key: str | None = None) -> DataFrame:
    """``(name, rows, nulls, null_share)`` per column from one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counted.unpivot(["rows"], list(df.columns), "name", "nulls")
    return long.select("name", "rows", "nulls", (F.col("nulls") / F.nullif(F.col("rows"), F.lit(0))).alias("null_share"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def quality_gate(df: DataFrame, expected: Sequence[str] = (), unique_key: str | None = None) -> dict:
    """Refuse an empty slice or missing columns; report repeated keys and columns mostly null."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing from the extract: {missing}")
    rows = quality_counts(df).collect()
    if not rows or rows[0]["rows"] == 0:
        raise ValueError("the extract is empty; check source, filter and cut-off")
    sparse = {r["name"]: r["null_share"] for r in rows if r["null_share"] > K.HIGH_NULL_SHARE}
    duplicates = 0
    if unique_key and unique_key in df.columns:
        duplicates = duplicate_keys(df, unique_key).first()["duplicates"]
    if duplicates:
        log.warning("%d repeated values of %s", duplicates, unique_key)
    if sparse:
        log.warning("columns mostly null: %s", sparse)
    return {"rows": rows[0]["rows"], "duplicates": duplicates, "mostly_null": sparse}


def high_water(df: DataFrame, key: str) -> DataFrame:
    """One row with the largest key as text; no row where there is none."""
    return df.agg(F.max(key).alias("top")).where("top IS NOT NULL").select(
        F.col("top").cast("string").alias("last_max_incremental_value")
    )


def load_mark(spark: SparkSession, path: str) -> str | None:
    try:
        state = spark.read.schema("last_max_incremental_value string, saved_at timestamp").parquet(path)
    except AnalysisException:
        return None
    row = state.orderBy(F.col("saved_at").desc()).first()
    return row["last_max_incremental_value"] if row else None


def save_mark(df: DataFrame, key: str | None, path: str) -> str | None:
    """Append the new mark; the state table keeps its history. Nothing is written for an empty slice."""
    if not key or key not in df.columns:
        return None
    mark = high_water(df, key).first()
    if mark is None:
        return None
    row = df.sparkSession.createDataFrame([(mark[0],)], "last_max_incremental_value string")
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return mark[0]


def ingest(spark: SparkSession, use_case: Mapping, since: str | None = None) -> dict:
    """Fetch the new slice, check it, write it to the raw table and move the mark.

    ``use_case`` holds ``source``, ``ingestion`` (``select_columns``, ``expected_columns``,
    ``incremental_key``, ``incremental_start``, ``lookback_days``, ``unique_key``, ``write_format``, ``publish``)
    and ``paths`` (``raw_data``, ``state``). With ``publish`` readers see each run as a whole or not at all, see
    ``merge_published``; it needs a date as incremental key. A source with ``dev_limit`` gives a sample: it is added to the raw
    table, replaces nothing stored, and does not move the mark.
    """
    rules, paths, source = use_case["ingestion"], use_case["paths"], use_case["source"]
    key = rules.get("incremental_key")
    first = since_value(since, load_mark(spark, paths["state"]), rules.get("incremental_start"),
                        rules.get("lookback_days", 0)) if key else None
    columns = selected_columns(rules)
    df = fetch(spark, source, columns)
    where = incremental_filter(df, first, key) if key else None
    df = df.where(where) if where is not None else df
    limited = bool(source.get("dev_limit"))
    df = df.limit(source["dev_limit"]) if limited else df
    # Gate, write and mark must see the same rows, however the source changes meanwhile.
    ensure_checkpoint_dir(spark)
    df = df.checkpoint()
    unique = rules.get("unique_key")
    unique = unique if unique in df.columns else None
    report = quality_gate(df, rules.get("expected_columns", ()), unique)
    fmt = output_format(rules, paths["raw_data"])
    dated = bool(key) and df.schema[key].dataType.simpleString().startswith(("timestamp", "date"))
    if rules.get("publish"):
        if not dated or fmt != "parquet":
            raise ValueError("'publish' needs a date as 'incremental_key' and Parquet as format")
        merge_published(df, paths["raw_data"], key, first, unique, complete=not limited)
    elif dated:
        merge_slice(df, paths["raw_data"], key, first, fmt, unique, complete=not limited)
    else:
        write_raw(df, paths["raw_data"], fmt, replace=not limited)
    # A limited run leaves rows out, so the next run must start where this one did.
    report["mark"] = None if limited else save_mark(df, key, paths["state"])
    return report
