"""The Arrow file source: partitions, pushed filters, lists of finished writes."""

from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendscope.sources import arrow_files, ingest, readers

SCHEMA = "id long, ts timestamp_ntz, amount double, name string"


@pytest.fixture()
def known(spark):
    start = datetime(2025, 5, 28)
    rows = [(k, start + timedelta(days=k) if k % 9 else None, float("nan") if k % 5 == 0 else k / 2, None if k % 7 == 0 else f"n{k}é")
            for k in range(60)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(a, b):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(a) == key(b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_append_and_replace(spark, tmp_path, known):
    path = str(tmp_path / "rows")
    arrow_files.write_arrow(known, path)
    source = {"type": "arrow", "path": path, "schema": SCHEMA}
    same(readers.open_source(spark, source), known)
    same(readers.open_source(spark, {"type": "arrow", "path": path}), known)
    arrow_files.write_arrow(known.limit(4), path)
    assert readers.open_source(spark, source).count() == 64
    arrow_files.write_arrow(known.where("id < 5"), path, replace=True)
    same(readers.open_source(spark, source), known.where("id < 5"))
    arrow_files.write_arrow(known.limit(0), path, replace=True)
    assert readers.open_source(spark, source).count() == 0


def test_incremental_filter_reaches_the_source(spark, tmp_path, known):
    path = str(tmp_path / "rows")
    arrow_files.write_arrow(known, path)
    df = readers.open_source(spark, {"type": "arrow", "path": path, "schema": SCHEMA})
    late = df.where(ingest.incremental_filter(df, "2025-06-20", "ts"))
    assert " Filter (" not in plan(late) and "BatchScan arrow_files" in plan(late)
    same(late, known.where("ts >= timestamp_ntz'2025-06-20 00:00:00'"))
    for test in ("id = 7", "name > 'n3'", "name is not null", "id < 9 and ts <= timestamp_ntz'2025-06-01 00:00:00'", "id in (1, 70, 3)", "ts is null"):
        same(df.where(test), known.where(test))
    over = df.where("amount >= 20")  # NaN is above every number for Spark.
    assert " Filter (" in plan(over) and over.count() == known.where("amount >= 20").count() > 20


def test_large_files_are_read_in_slices(spark, tmp_path):
    table = pa.table({"id": pa.array(range(10_000), pa.int64())})
    with pa.ipc.new_file(str(tmp_path / "one.arrow"), table.schema) as sink:
        sink.write_table(table, max_chunksize=500)
    for slices in (1 << 30, 20_000, 1):
        df = readers.open_source(spark, {"type": "arrow", "path": str(tmp_path / "one.arrow"), "slice_bytes": max(slices, 2_000)})
        assert (df.rdd.getNumPartitions() > 1) == (slices < 1 << 30)
        assert df.agg(F.count("*"), F.sum("id"), F.countDistinct("id")).first() == (10_000, 49_995_000, 10_000)


def test_a_failed_write_is_not_read(spark, tmp_path, known):
    path = str(tmp_path / "rows")
    arrow_files.write_arrow(known, path)
    broken = known.withColumn("amount", F.when(F.col("id") == 50, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        arrow_files.write_arrow(broken, path)
    same(readers.open_source(spark, {"type": "arrow", "path": path, "schema": SCHEMA}), known)


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        readers.open_source(spark, {"type": "arrow", "path": str(tmp_path / "nowhere"), "schema": SCHEMA}).count()
