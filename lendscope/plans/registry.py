"""Registration of queries with their checking SQL, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.functions.expressions import HASH_MODULUS
from lendscope.operators.quantiles import even_probs
from lendscope.plans import loans as L

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; floating results are rounded alike on both sides."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    changes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changes[f.name] = F.round(f.name, digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            changes[f.name] = F.col(f.name).cast("long")
    return df.withColumns(changes) if changes else df


EVENT_CTE = f"{L.LOAN_CTES}, lv AS (SELECT *, CASE WHEN paid_on_time = 0 THEN 1 ELSE 0 END AS event FROM loans)"
SPLIT_CTE = f"""{EVENT_CTE},
train AS (SELECT * FROM lv WHERE disbursed_at < TIMESTAMP '{L.AFTER_CUTOFF}'),
test AS (SELECT * FROM lv WHERE disbursed_at >= TIMESTAMP '{L.AFTER_CUTOFF}')"""


def on_loans(body: str) -> str:
    """SQL over ``loans`` and ``lv`` (with the event); ``body`` may start with more CTEs."""
    return f"WITH {EVENT_CTE}{body}"


def on_split(body: str) -> str:
    """SQL over ``lv``, ``train`` and ``test``."""
    return f"WITH {SPLIT_CTE}{body}"


def hash_sql(key: str, seed: str) -> str:
    p = HASH_MODULUS
    folded = f"({key} % {p} + CAST(floor({key} / {p}e0) AS BIGINT) % {p} * 31 + ({seed}) * 7919)"
    x = f"({folded} % {p})"
    square = f"({x} * {x} % {p})"
    return f"({square} * {square} % {p} * {x} % {p})"


def prob_list(parts: int) -> str:
    return "[" + ", ".join(f"{p!r}e0" for p in even_probs(parts)) + "]"


def union_all(template: str, names: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in names)


def bin_sql(value: str, edges: str) -> str:
    return f"greatest(1, len(list_filter({edges}, lambda e: e < {value})))"


def case_bucket(col: str, bins: Sequence[float], labels: Sequence[str]) -> str:
    whens = " ".join(
        f"WHEN {col} >= {lo} AND {col} < {hi} THEN '{label}'" for lo, hi, label in zip(bins, bins[1:], labels)
    )
    return f"CASE {whens} END"
