"""Stateless features: ratios, sums, shares, date parts, buckets, catalogue cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import expressions as E


def add_missing(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add only the columns the table does not have yet, so that applying twice changes nothing."""
    fresh = {name: col for name, col in columns.items() if name not in df.columns}
    return df.withColumns(fresh) if fresh else df


def _numerator(spec: Mapping) -> Column:
    return E.total(spec["numerator_sum"]) if "numerator_sum" in spec else F.col(spec["numerator"])


def ratio_features(df: DataFrame, specs: Iterable[Mapping]) -> DataFrame:
    """``{name, numerator | numerator_sum, denominator, denominator_add}`` per feature."""
    return add_missing(df, {
        s["name"]: E.ratio(_numerator(s), F.col(s["denominator"]), s.get("denominator_add") or 0) for s in specs
    })


def sum_features(df: DataFrame, specs: Iterable[Mapping]) -> DataFrame:
    return add_missing(df, {s["name"]: E.total(s["cols"]) for s in specs})


def share_features(df: DataFrame, specs: Iterable[Mapping]) -> DataFrame:
    """Shares whose denominator may be a sum created just before."""
    return add_missing(df, {
        s["name"]: E.ratio(F.col(s["numerator"]), F.col(s["denominator"])) for s in specs
    })


def date_features(df: DataFrame, date_col: str, spec: Mapping) -> DataFrame:
    if date_col not in df.columns:
        return df
    ts = E.as_timestamp(df, date_col)
    return add_missing(df, {
        spec.get("year_col", "year"): F.year(ts),
        spec.get("month_col", "month"): F.month(ts),
        spec.get("weekday_col", "weekday"): E.weekday_name(ts),
        spec.get("age_col", "age_days"): E.whole_days_until(spec["reference_date"], ts),
    })


def bucket_features(df: DataFrame, specs: Iterable[Mapping]) -> DataFrame:
    """``{name, col, bins, labels, right}`` per feature; an absent source column is skipped."""
    return add_missing(df, {
        s["name"]: E.bucket(F.col(s["col"]), s["bins"], s["labels"], s.get("right", False))
        for s in specs if s["col"] in df.columns
    })


def derive(df: DataFrame, spec: Mapping) -> DataFrame:
    """All derived features in their fixed order: ratios, sums, shares, dates, buckets."""
    df = ratio_features(df, spec.get("ratios", ()))
    df = sum_features(df, spec.get("sums", ()))
    df = share_features(df, spec.get("shares", ()))
    if spec.get("dates"):
        df = date_features(df, spec["dates"]["col"], spec["dates"])
    return bucket_features(df, spec.get("buckets", ()))


def clean_categories(df: DataFrame, catalogues: Mapping[str, Sequence[str]]) -> DataFrame:
    present = {c: E.keep_catalogue(F.col(c), valid) for c, valid in catalogues.items() if c in df.columns}
    return df.withColumns(present) if present else df


def drop_columns(df: DataFrame, *groups: Iterable[str]) -> DataFrame:
    return df.drop(*dict.fromkeys(c for group in groups for c in group))


def require_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {sorted(df.columns)}")


def stateless(df: DataFrame, config: Mapping) -> DataFrame:
    """Derived features, then catalogue cleaning. Learns nothing, so it may run before the split."""
    return clean_categories(derive(df, config.get("derived", {})), config.get("catalogues", {}))


def add_event(df: DataFrame, label: str, event: str) -> DataFrame:
    return df.withColumn(event, E.event_flag(F.col(label)))
