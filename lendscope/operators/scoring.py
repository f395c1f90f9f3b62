"""Batch scoring: the fitted steps and a model applied to new rows."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions import constants as K
from lendscope.functions.expressions import decision, event_names, parse_timestamp, risk_band
from lendscope.operators.boosting import BoostedTrees
from lendscope.operators.features import drop_columns
from lendscope.operators.fitted import apply_fitted
from lendscope.operators.training import Fitted, add_probability
from lendscope.sources.readers import read_frame

SCORE_DIGITS = 6


def prediction_id(key: Column, version: str) -> Column:
    """A repeatable id: the same row scored by the same model version keeps its id on a retry."""
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(version)), 256)


def prediction_columns(
    score: Column, key: Column, event: str, threshold: float, version: str, scored_at: Column,
    low: float = K.RISK_LOW_SHARE, mid: float = K.RISK_MID_SHARE,
) -> dict[str, Column]:
    """The columns a scored row gets; decision and band use the unrounded score."""
    names = event_names(event)
    return {
        "prediction_id": prediction_id(key, version),
        names["score_col"]: F.round(score, SCORE_DIGITS),
        names["pred_col"]: decision(score, threshold),
        "risk_level": risk_band(score, threshold, low, mid),
        "predicted_at": scored_at,
    }


def check_batch_size(df: DataFrame, limit: int = K.BATCH_LIMIT) -> None:
    """Refuse a batch over ``limit`` rows; looks at one row more than that."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"the batch holds more than {limit} rows")


def score_batch(
    source: DataFrame | str, fitted: Fitted, params: DataFrame, config: Mapping, event: str, key: str,
    version: str = "1", scored_at: datetime | None = None, max_rows: int | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Score rows end to end: ``(key, date, prediction columns, feature columns)``.

    Dates are parsed, leakage and target columns removed, stateless and fitted steps applied with
    the saved parameters, then the model. There is no row limit unless ``max_rows`` is given.
    """
    df = read_frame(source, spark)
    if max_rows is not None:
        check_batch_size(df, max_rows)
    date_col = config["date_col"]
    if date_col in df.columns and df.schema[date_col].dataType.simpleString() == "string":
        df = df.withColumn(date_col, parse_timestamp(date_col))
    df = drop_columns(df, config.get("leakage", ()), [event])
    dated = date_col in df.columns
    held = [key, "_date"] if dated else [key]
    df = df.withColumn("_date", F.col(date_col)) if dated else df
    features = apply_fitted(df, params, config, held)
    scored = add_probability(fitted.model, features, fitted.features, "_score")
    when = F.lit(scored_at) if scored_at else F.current_timestamp()
    columns = prediction_columns(
        F.col("_score"), F.col(key), event, fitted.threshold, version, when.cast("timestamp_ntz")
    )
    lead = [F.col(key)] + ([F.col("_date").alias(date_col)] if dated else [])
    return scored.select(*lead, *[c.alias(n) for n, c in columns.items()], *fitted.features)


def save_model(fitted: Fitted, path: str) -> None:
    if isinstance(fitted.model, BoostedTrees):
        fitted.model.save(SparkSession.active(), path)
    else:
        PipelineModel([fitted.model]).write().overwrite().save(path)


def load_model(path: str, name: str, features: list[str], threshold: float) -> Fitted:
    """A saved model under its own path; boosted trees are two tables, every other model a Spark ML pipeline."""
    try:
        model = BoostedTrees.load(SparkSession.active(), path)
    except AnalysisException:
        model = PipelineModel.load(path).stages[0]
    return Fitted(name, model, features, threshold)
