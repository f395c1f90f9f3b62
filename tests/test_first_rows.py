"""The ingestion stream keeps its keys in Spark's own state and chooses rows in compiled code."""

from datetime import datetime

from pyspark.sql import functions as F

from lendscope.streaming.first_rows import first_of_batch, marked_rows
from lendscope.streaming.streams import read_files, stream_ingest

SCHEMA = "id long, day timestamp_ntz, note string, more map<string,int>"


def day(n):
    return datetime(2024, 1, n)


def test_keys_and_rows_never_pass_through_python(spark, tmp_path):
    rows, known = (read_files(spark, str(tmp_path), spark.createDataFrame([], s).schema) for s in (SCHEMA, "id long"))
    marked = marked_rows(rows, "id", known)
    plan = marked._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "Python" not in plan and "TransformWithState" not in plan
    batch = spark.createDataFrame([], marked.schema)
    assert "Python" not in first_of_batch(batch, "id", "day")._jdf.queryExecution().toString()


def test_a_batch_keeps_the_earliest_row_of_new_keys_only(spark):
    rows = [(1, day(3), "b", None, "row"), (1, day(2), "c", {"x": 1}, "row"), (1, day(2), "a", None, "row"), (1, None, None, None, "row"),
            (2, None, "u", {"y": 2}, "row"), (3, day(1), "n", None, "row"), (4, day(1), "n", None, "row"),
            *[(None, day(5), "k", None, "row")] * 2, (None, None, None, None, "row")]
    marks = [(i, None, None, None, kind) for i, kind in ((1, "new"), (2, "new"), (3, "new"), (3, "known"), (5, "new"), (5, "known"))]
    batch = spark.createDataFrame(rows + marks, SCHEMA + ", _kind string")
    got = [tuple(r) for r in first_of_batch(batch, "id", "day").collect()]
    want = [(1, day(2), "a", None), (2, None, "u", {"y": 2}), *[(None, day(5), "k", None)] * 2, (None, None, None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plain = first_of_batch(batch.drop("more"), "id", "day").collect()
    assert sorted((tuple(r) for r in plain), key=repr) == sorted((w[:3] for w in want), key=repr)


def test_keys_stored_before_count_in_later_batches_too(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "sink", "check"))
    flat = "id long, day timestamp_ntz, note string"
    old = spark.createDataFrame([(1, day(9), "old"), (2, day(9), "old"), (None, day(9), "old")], flat)
    old.withColumn("part_month", F.lit("2024-01")).write.partitionBy("part_month").parquet(sink)
    for rows in ([(1, day(1), "new"), (3, day(1), "new")], [(2, day(1), "new"), (3, day(1), "again"), (4, day(1), "new"), (None, day(1), "new")]):
        spark.createDataFrame(rows, flat).coalesce(1).write.mode("append").parquet(source)
        found = stream_ingest(spark, source, old.schema, "id", "day", None, sink, check)
    assert sorted(((r["id"], r["note"]) for r in found.collect()), key=repr) == sorted(
        [(1, "old"), (2, "old"), (None, "old"), (3, "new"), (4, "new"), (None, "new")], key=repr)
