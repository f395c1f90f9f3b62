"""Batch sources chosen by name, always read with an explicit column list."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.sources.arrow_files import read_arrow

Reader = Callable[[SparkSession, Mapping], DataFrame]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in floating columns, because Spark orders NaN above every number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_csv(spark: SparkSession, options: Mapping) -> DataFrame:
    """``path``, ``schema`` (DDL or StructType), ``sep``, ``encoding``. Types are never inferred."""
    reader = spark.read.option("header", True).option("sep", options.get("sep", ","))
    reader = reader.option("encoding", options.get("encoding", "utf-8"))
    # With a header the file's own column order counts, so the schema is applied by name.
    text = reader.csv(options["path"])
    schema = options.get("schema")
    if schema is None:
        return text
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in wanted if f.name not in text.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {options['path']}")
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_parquet(spark: SparkSession, options: Mapping) -> DataFrame:
    return spark.read.parquet(options["path"])


def read_table(spark: SparkSession, options: Mapping) -> DataFrame:
    """A catalogue table by ``table``, or any installed connector by ``format`` and ``options``."""
    if options.get("format"):
        return spark.read.format(options["format"]).options(**options.get("options", {})).load()
    parts = [options.get("project"), options.get("dataset"), options["table"]]
    return spark.table(".".join(p for p in parts if p))


_READERS: dict[str, Reader] = {"csv": read_csv, "parquet": read_parquet, "table": read_table, "arrow": read_arrow}


def register_source(kind: str, reader: Reader) -> None:
    _READERS[kind.lower()] = reader


def open_source(spark: SparkSession, source: Mapping) -> DataFrame:
    kind = source.get("type")
    if not kind:
        raise KeyError(f"the source needs a 'type'; known: {sorted(_READERS)}")
    reader = _READERS.get(kind.lower())
    if reader is None:
        raise NotImplementedError(f"source {kind!r} is not registered; known: {sorted(_READERS)}")
    return reader(spark, {k: v for k, v in source.items() if k not in ("type", "dev_limit")})


def fetch(
    spark: SparkSession, source: Mapping, columns: Sequence[str], where: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Selected columns of a source; filter, projection and limit reach the scan."""
    df = open_source(spark, source)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the source")
    if where is not None:
        df = df.where(where)
    df = nan_to_null(df.select(*columns))
    return df.limit(limit) if limit else df


def selected_columns(ingestion: Mapping) -> list[str]:
    columns = ingestion.get("select_columns") or ingestion.get("expected_columns")
    if not columns:
        raise ValueError("list the columns in 'select_columns' or 'expected_columns'")
    return list(columns)


def read_raw(spark: SparkSession, paths: Mapping, override: str | None = None, schema: str | None = None) -> DataFrame:
    """The raw table by file extension: an explicit path, else ``raw_data``, else ``base_data_csv``."""
    path = override or paths.get("raw_data") or paths.get("base_data_csv")
    if not path:
        raise FileNotFoundError("neither 'raw_data' nor 'base_data_csv' is set")
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "csv"):
        raise ValueError(f"unsupported raw format {suffix!r}; use .parquet or .csv")
    return nan_to_null(_READERS[suffix](spark, {"path": path, "schema": schema}))


def read_frame(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is, or a path read by its extension."""
    if isinstance(source, DataFrame):
        return source
    return read_raw(spark or SparkSession.active(), {"raw_data": source})
