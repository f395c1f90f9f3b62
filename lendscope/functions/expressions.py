"""Column builders. Every function returns a Column and never touches data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import constants as K

HASH_MODULUS = 1_000_003


def as_number(col: Column | str) -> Column:
    """Double value of a column; text that is no number, and NaN, become null."""
    number = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(number), number)


def total(cols: Sequence[str]) -> Column:
    return reduce(add, [F.col(c) for c in cols])


def ratio(numerator: Column, denominator: Column, offset: float = 0) -> Column:
    """``numerator / (denominator + offset)``; a zero divisor gives null."""
    divisor = as_number(denominator)
    if offset:
        divisor = divisor + F.lit(float(offset))
    return numerator / F.nullif(divisor, F.lit(0.0))


def whole_days_until(reference: str, ts: Column) -> Column:
    """Whole days from ``ts`` to a fixed date, rounded towards minus infinity."""
    gap = F.timestamp_diff("MICROSECOND", ts, F.lit(reference).cast("timestamp_ntz"))
    return F.floor(gap / F.lit(86_400_000_000.0)).cast("long")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parse_timestamp(col: Column | str, fmt: str | None = None) -> Column:
    """Timestamp without zone; unreadable text gives null, zoned text is taken as UTC.

    The session time zone must be UTC, as for every job of this library.
    """
    source = F.col(col) if isinstance(col, str) else col
    text = source.cast("string")
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return parsed.cast("timestamp_ntz")


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A date column as timestamp without zone, whatever its type; unreadable text gives null."""
    return parse_timestamp(name) if df.schema[name].dataType.simpleString() == "string" else F.col(name).cast("timestamp_ntz")


def bucket(col: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the interval holding the value; outside all intervals, null.

    ``right=False`` gives ``[lo, hi)`` and leaves the last edge out, ``right=True`` gives ``(lo, hi]``.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    expr = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = (col > lo) & (col <= hi) if right else (col >= lo) & (col < hi)
        expr = F.when(inside, label) if expr is None else expr.when(inside, label)
    return expr


def keep_catalogue(col: Column, valid: Sequence[str]) -> Column:
    return F.when(col.isin(list(valid)), col)


def event_flag(label: Column) -> Column:
    """1 where the label is 0, else 0, also for a missing label."""
    return F.when(label == 0, 1).otherwise(0)


def stepped_label(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """Label of the first step whose upper limit lies above the value."""
    expr = F.when(value.isNull(), None)
    for limit, label in steps:
        expr = expr.when(value < limit, label)
    return expr.otherwise(last)


def significance(p_value: Column) -> Column:
    return stepped_label(p_value, K.SIGNIFICANCE, K.NOT_SIGNIFICANT)


def iv_power(iv: Column) -> Column:
    return stepped_label(iv, K.IV_POWER, K.IV_SUSPICIOUS)


def psi_status(psi: Column, stable: float = K.PSI_STABLE_BELOW, monitor: float = K.PSI_MONITOR_BELOW) -> Column:
    calm, watch, drift = K.PSI_LABELS
    return stepped_label(psi, [(stable, calm), (monitor, watch)], drift)


def risk_band(
    score: Column, threshold: float, low: float = K.RISK_LOW_SHARE, mid: float = K.RISK_MID_SHARE
) -> Column:
    """Band of a score relative to the decision threshold."""
    low_label, mid_label, high_label = K.RISK_LABELS
    return stepped_label(score, [(threshold * low, low_label), (threshold * mid, mid_label)], high_label)


def decision(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")


def event_names(event: str) -> dict[str, str]:
    """Column names used in prediction logs for one event."""
    return {
        "event_col": event,
        "event_title": event.replace("_", " ").title(),
        "score_col": f"score_{event}",
        "pred_col": f"pred_{event}",
        "actual_col": f"{event}_real",
    }


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def find_column(df: DataFrame, name: str) -> str:
    """A column by its name, or by the part after ``__`` in an assembled feature table."""
    if name in df.columns:
        return name
    for candidate in df.columns:
        if candidate.endswith(f"__{name}"):
            return candidate
    raise KeyError(f"no column {name!r}; available: {sorted(df.columns)}")


def order_number(df: DataFrame, key: str, whole_row: bool = True) -> Column:
    """A 64-bit number for ``key_hash``: an integer key itself, else 60 bits of the MD5 of the key's text.

    With ``whole_row`` a missing key is replaced by the text of the row, so that rows without a key spread as well; then every column
    is read. Without it a missing key has no number.
    """
    digits = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    integer = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(f"`{key}`").cast("long") if integer else digits(F.col(f"`{key}`").cast("string"))
    if not whole_row:
        return number
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return F.when(number.isNull(), digits(row)).otherwise(number)


def key_hash(key: Column, seed: Column | int = 0) -> Column:
    """Pseudo-random order value of an integer key, below ``HASH_MODULUS``.

    The fifth power permutes the residues of this prime, so keys spread evenly over all values.
    Only 64-bit integer arithmetic is used, which any SQL engine repeats exactly.
    """
    p = F.lit(HASH_MODULUS).cast("long")
    k = key.cast("long")
    salt = seed if isinstance(seed, Column) else F.lit(seed)
    folded = k % p + F.floor(k / F.lit(float(HASH_MODULUS))).cast("long") % p * 31 + salt.cast("long") * 7919
    x = F.pmod(folded, p)
    square = x * x % p
    return square * square % p * x % p


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """1-based bin between sorted distinct edges, right-closed; the first bin holds the minimum."""
    passed = reduce(add, [F.when(value > F.lit(float(e)), 1).otherwise(0) for e in edges])
    return F.when(value.isNotNull(), F.greatest(F.lit(1), passed))
