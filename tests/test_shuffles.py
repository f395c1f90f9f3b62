"""Repeats without copies against copies, for any key; what splits and folds read."""

import re

import pytest
from pyspark.sql import functions as F

from lendscope.operators import splits

SIZES = [0.1, 0.325, 0.55, 0.775, 1.0]


@pytest.mark.parametrize("key, rows", [
    ("id", 400), ("id", 7), ("id", 1), ("concat('k', id % 1000)", 300), ("id * 1000003 + 7", 500), ("id + 4611686018427387904L", 200),
    ("if(id % 5 = 0, null, id)", 150), ("id % 7", 150), ("date_add(DATE '2020-01-01', cast(id as int))", 90),
])
def test_parts_equal_the_copies(spark, key, rows):
    df = spark.range(rows).selectExpr("id AS row", f"{key} AS key", "id % 3 AS other").repartition(3)
    sized = splits._copies(df, "key", 4, SIZES, 0.2, 42).groupBy("repeat", "part").count()
    found = splits.repeated_shuffles(df, "key", 4, SIZES)
    counts = lambda d: sorted((r["repeat"], r["part"], r["count"]) for r in d.collect())
    assert counts(found.groupBy("repeat", "part").count()) == counts(sized)
    if "%" not in key.replace("% 1000", ""):
        want = splits._copies(df, "key", 4, SIZES, 0.2, 42).select("row", "repeat", "part")
        assert sorted(map(tuple, found.select("row", "repeat", "part").collect())) == sorted(map(tuple, want.collect()))


def test_keys_that_share_a_hash_at_a_cut(spark, monkeypatch):
    """With all hashes equal the keys alone decide."""
    monkeypatch.setattr(splits, "key_hash", lambda number, seed=0: number * 0 + 5)
    df = spark.range(50).selectExpr("id AS key")
    got = splits.shuffle_parts(df, "key", 2, [0.5, 1.0]).orderBy("key").collect()
    assert [r.parts for r in got] == [[0, 0]] * 10 + [[1, 1]] * 20 + [[2, 2]] * 20


def test_no_rows(spark):
    assert splits.shuffle_parts(spark.range(0).selectExpr("id AS key"), "key", 3, SIZES).count() == 0


def test_only_key_and_strata_are_read(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(500).selectExpr("id AS key", "cast(id % 4 = 0 AS int) AS event", *[f"id * {k} AS extra{k}" for k in range(20)]).write.parquet(path)
    df = spark.read.parquet(path)
    for counted in (splits.folds(df, "key", 5, ["event"]).groupBy("fold").count(),
                    splits.stratified_split(df, "key", "event")[0].groupBy("event").count()):
        counted.collect()
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) and "extra" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
