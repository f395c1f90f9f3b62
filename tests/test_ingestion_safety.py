"""Nothing stored is lost: cut-offs however written, limited runs, missing and repeated keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lendscope.sources import ingest, readers, sinks
from lendscope.streaming import streams

SCHEMA = "id long, ts timestamp_ntz, amount double"


def rows(spark, first, days, start=datetime(2025, 5, 28)):
    return spark.createDataFrame([(first + k, start + timedelta(days=k), float(k)) for k in range(days)], SCHEMA)


def stored(spark, path):
    return sorted(((r.id, r.ts, r.amount) for r in spark.read.parquet(path).collect()), key=repr)


@pytest.mark.parametrize("since", ["2025-6-10", "2025-06-10", "2025-06-10T00:00:00"])
def test_rows_before_the_cut_off_stay(spark, tmp_path, since):
    path, whole = str(tmp_path / "raw"), rows(spark, 0, 40)
    sinks.merge_slice(whole, path, "ts", None)
    late = whole.where(ingest.incremental_filter(whole, since, "ts")).withColumn("amount", F.col("amount") + 100)
    sinks.merge_slice(late, path, "ts", since)
    found = stored(spark, path)
    assert len(found) == 40 and sum(r[2] >= 100 for r in found) == late.count() == 27


def test_undated_rows_stay(spark, tmp_path):
    path = str(tmp_path / "raw")
    undated = spark.createDataFrame([(900, None, 1.0), (None, None, 2.0)], SCHEMA)
    sinks.merge_slice(rows(spark, 0, 30).unionByName(undated), path, "ts", None)
    sinks.merge_slice(rows(spark, 30, 5, datetime(2025, 6, 27)).unionByName(undated.limit(0)), path, "ts", "2025-06-27")
    assert len(stored(spark, path)) == 37


def test_each_key_once_and_rows_without_key_kept(spark, tmp_path):
    path = str(tmp_path / "raw")
    day = lambda m, d: datetime(2025, m, d)
    first = [(1, day(5, 1), 1.0), (None, day(5, 2), 2.0), (None, day(5, 2), 2.0), (2, day(6, 20), 3.0), (2, day(6, 12), 4.0)]
    sinks.merge_slice(spark.createDataFrame(first, SCHEMA), path, "ts", None, unique_key="id")
    second = [(1, day(7, 1), 5.0), (3, day(7, 2), 6.0), (3, day(8, 2), 7.0), (3, day(7, 2), 5.5), (None, day(7, 3), 8.0), (2, day(7, 9), 9.0)]
    sinks.merge_slice(spark.createDataFrame(second, SCHEMA), path, "ts", "2025-7-1", unique_key="id")
    want = [(1, day(5, 1), 1.0), (2, day(6, 12), 4.0), (3, day(7, 2), 5.5), (None, day(5, 2), 2.0), (None, day(5, 2), 2.0), (None, day(7, 3), 8.0)]
    assert stored(spark, path) == sorted(want, key=repr)


def case(tmp_path, source, **more):
    return {"source": {"type": "parquet", "path": source, **more}, "paths": {"raw_data": str(tmp_path / "raw"), "state": str(tmp_path / "state")},
            "ingestion": {"select_columns": ["id", "ts", "amount"], "incremental_key": "ts", "unique_key": "id"}}


def test_a_limited_run_replaces_nothing(spark, tmp_path):
    source = str(tmp_path / "source")
    rows(spark, 0, 40).write.parquet(source)
    full = ingest.ingest(spark, case(tmp_path, source))
    assert full["rows"] == 40 and full["mark"] is not None
    before = stored(spark, str(tmp_path / "raw"))
    rows(spark, 100, 30, datetime(2025, 6, 20)).write.mode("append").parquet(source)
    limited = ingest.ingest(spark, case(tmp_path, source, dev_limit=5), since="2025-6-1")
    after = stored(spark, str(tmp_path / "raw"))
    assert set(before) <= set(after) and len(after) <= len(before) + 5 and limited["mark"] is None
    again = ingest.ingest(spark, case(tmp_path, source))
    assert again["mark"] > full["mark"]


def test_a_limited_run_without_key_refuses_to_overwrite(spark, tmp_path):
    source = str(tmp_path / "source")
    rows(spark, 0, 10).write.parquet(source)
    use = case(tmp_path, source, dev_limit=3)
    use["ingestion"].pop("incremental_key")
    ingest.ingest(spark, use)
    with pytest.raises(Exception, match="(?i)already exists"):
        ingest.ingest(spark, use)


def test_stream_keeps_rows_without_key_and_the_earliest_of_a_key(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    day = lambda m, d: datetime(2025, m, d)
    schema = spark.createDataFrame([], SCHEMA).schema
    first = [(None, day(5, d), 0.0) for d in range(1, 11)] + [(1, day(6, 2), 1.0), (1, day(5, 3), 2.0)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    streams.stream_ingest(spark, source, schema, "id", "ts", "2025-5-1", sink, check)
    spark.createDataFrame([(1, day(7, 1), 3.0), (2, day(7, 1), 4.0), (None, day(4, 1), 5.0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    found = streams.stream_ingest(spark, source, schema, "id", "ts", "2025-5-1", sink, check)
    rows_ = sorted(((r.id, r.ts) for r in found.collect() if r.id is not None), key=repr)
    assert rows_ == [(1, day(5, 3)), (2, day(7, 1))] and found.where("id IS NULL").count() == 10


def test_table_scan_and_reference_snapshot(spark, tmp_path):
    rows(spark, 0, 6).createOrReplaceTempView("safety_rows")
    got = readers.fetch(spark, {"type": "table", "table": "safety_rows"}, ["id"], F.col("amount") > 2)
    assert sorted(r.id for r in got.collect()) == [3, 4, 5]
    sinks.write_reference(rows(spark, 0, 6), str(tmp_path / "reference"))
    assert spark.read.parquet(str(tmp_path / "reference")).count() == 6
