"""Keyed state of the ingestion stream: one rule with the batch merge, restarts, and the work of a batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lendscope.sources.sinks import one_per_key
from lendscope.streaming import streams
from lendscope.streaming.first_rows import sort_key

SCHEMA = "id long, day timestamp_ntz, note string, amount double"


def rows_of(seed, count, keys):
    r = random.Random(seed)
    day = datetime(2024, 1, 1)
    return [(r.choice([None, *range(keys)]), r.choice([None, day + timedelta(days=r.randrange(70))]), r.choice([None, "a", "é", "z"]),
             r.choice([None, float("nan"), -1.5, 2.0])) for _ in range(count)]


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def listed(df):
    return sorted((repr(tuple(r)) for r in df.select("id", "day", "note", "amount").collect()))


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / n) for n in ("src", "sink", "check")]


def ingest(spark, paths, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return streams.stream_ingest(spark, paths[0], schema, "id", "day", None, paths[1], paths[2], **more)


def test_each_batch_follows_the_rule_of_the_merge(spark, paths):
    """Keys repeat inside a batch and over batches; ties, nulls and missing keys are told apart as in the batch merge."""
    want = None
    for batch in range(3):
        rows = rows_of(batch, 120, 60 + 20 * batch)
        write(spark, rows, paths[0])
        fresh = one_per_key(spark.createDataFrame(rows, SCHEMA), "id", "day", want)
        want = fresh if want is None else want.unionByName(fresh)
        assert listed(ingest(spark, paths)) == listed(want)


def test_a_first_run_knows_the_rows_of_an_earlier_merge(spark, paths):
    old = spark.createDataFrame([(1, datetime(2024, 5, 1), "kept", 1.0)], SCHEMA)
    old.withColumn("part_month", F.lit("2024-05")).write.partitionBy("part_month").parquet(paths[1])
    write(spark, [(1, datetime(2023, 1, 1), "later", 2.0), (2, None, "new", 3.0)], paths[0])
    assert listed(ingest(spark, paths)) == sorted(repr((i, d, n, a)) for i, d, n, a in [
        (1, datetime(2024, 5, 1), "kept", 1.0), (2, None, "new", 3.0)])


@pytest.mark.parametrize("fails_at", [0, 1])
def test_a_batch_that_failed_after_writing_is_repeated_without_repeats(spark, paths, fails_at, monkeypatch):
    """The second half of a batch's work is lost: its files stay, its commit does not."""
    rows = [rows_of(k, 50, 40) for k in range(2)]
    whole = None
    for batch in range(2):
        write(spark, rows[batch], paths[0])
        if batch == fails_at:
            broken = type(spark.range(1).write)
            save = broken.parquet

            def fail(self, path, *args, **kwargs):
                save(self, path, *args, **kwargs)
                raise OSError("the driver is lost")

            with monkeypatch.context() as m:
                m.setattr(broken, "parquet", fail)
                with pytest.raises(Exception, match="the driver is lost"):
                    ingest(spark, paths)
        fresh = one_per_key(spark.createDataFrame(rows[batch], SCHEMA), "id", "day", whole)
        whole = fresh if whole is None else whole.unionByName(fresh)
        assert listed(ingest(spark, paths)) == listed(whole)


def test_a_batch_does_not_read_the_table(spark, paths):
    """Once begun, the stream goes on when the stored files cannot be read at all."""
    write(spark, [(k, datetime(2024, 1, 1), "x", 0.0) for k in range(30)], paths[0])
    ingest(spark, paths)
    write(spark, [(k, datetime(2024, 2, 1), "x", 0.0) for k in range(20, 40)], paths[0])
    looked = []
    original = streams.read_table

    def spy(*args):
        looked.append(args)
        return original(*args)

    streams.read_table = spy
    try:
        result = ingest(spark, paths)
    finally:
        streams.read_table = original
    assert len(looked) == 1  # the result, not the batch
    assert result.count() == 40


def test_values_sort_as_in_spark(spark):
    values = [(None,), (float("-inf"),), (-1.0,), (0.0,), (2.5,), (float("inf"),), (float("nan"),)]
    want = [r[0] for r in spark.createDataFrame(random.Random(1).sample(values, len(values)), "x double").orderBy("x").collect()]
    assert repr(want) == repr([v[0] for v in sorted(values, key=sort_key)])
    words = ["", "Z", "a", "é", "￿", "\U0001f600"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "x string").orderBy("x").collect()] == sorted(words, key=sort_key)
