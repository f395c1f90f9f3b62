"""Rule baseline: a row is an event when enough threshold rules are active."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.expressions import as_number, find_column

# The comparison signs a rule may use.
COMPARISONS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}


def rule_signal(df: DataFrame, rule: Mapping) -> Column:
    """1 when the rule holds. A missing value makes no rule hold, except ``!=``."""
    if rule["op"] not in COMPARISONS:
        raise ValueError(f"unknown comparison {rule['op']!r}; known: {list(COMPARISONS)}")
    value = as_number(find_column(df, rule["col"]))
    holds = COMPARISONS[rule["op"]](value, F.lit(float(rule["threshold"])))
    return F.coalesce(holds, F.lit(rule["op"] == "!=")).cast("int")


def rule_columns(df: DataFrame, rules: Sequence[Mapping], min_signals: int = 2) -> dict[str, Column]:
    if not rules:
        raise ValueError("at least one rule is needed")
    active = reduce(operator.add, [rule_signal(df, r) for r in rules])
    return {"signals": active, "score": active / F.lit(float(len(rules))), "pred": (active >= min_signals).cast("int")}


def add_rule_score(df: DataFrame, rules: Sequence[Mapping], min_signals: int = 2) -> DataFrame:
    """Add ``signals`` (active rules), ``score`` (their share) and ``pred``."""
    return df.withColumns(rule_columns(df, rules, min_signals))
