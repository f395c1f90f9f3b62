import pytest
from pyspark.sql import functions as F

from lendscope.operators import monitoring, rules, scoring
from lendscope.sources import ingest, readers, sinks
from lendscope.sources.workspace import settle, shared_dir
from lendscope.streaming import streams


@pytest.fixture
def loans(spark):
    return spark.sql("""
      SELECT id, CAST(TIMESTAMP'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS TIMESTAMP_NTZ) AS day,
             id * 1.5D AS amount FROM range(120)""")


def test_csv_columns_types_and_errors(spark, tmp_path):
    folder = tmp_path / "raw.csv"
    folder.mkdir()
    (folder / "part.csv").write_text("a;b;c\n1;x;2.5\n2;y;nope\n3;z;NaN\n")
    source = {"type": "CSV", "path": str(folder), "sep": ";", "schema": "c double, a int", "dev_limit": 5}
    got = readers.fetch(spark, source, ["a", "c"], F.col("a") > 1).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(2, None), (3, None)]
    with pytest.raises(ValueError, match="zz"):
        readers.fetch(spark, source, ["zz"])
    with pytest.raises(ValueError, match="d"):
        readers.open_source(spark, {**source, "schema": "d int"})


def test_source_choice(spark, loans, tmp_path):
    with pytest.raises(KeyError):
        readers.open_source(spark, {})
    with pytest.raises(NotImplementedError):
        readers.open_source(spark, {"type": "other"})
    readers.register_source("Made", lambda s, o: loans.limit(o["n"]))
    assert readers.open_source(spark, {"type": "made", "n": 3}).count() == 3
    loans.createOrReplaceTempView("loans_view")
    assert readers.fetch(spark, {"type": "table", "table": "loans_view"}, ["id"], limit=4).count() == 4
    path = str(tmp_path / "x.parquet")
    loans.write.parquet(path)
    assert readers.read_raw(spark, {"raw_data": path}).count() == 120
    assert readers.read_frame(path, spark).count() == 120 and readers.read_frame(loans) is loans
    with pytest.raises(ValueError):
        readers.read_raw(spark, {}, override="x.xlsx")
    with pytest.raises(FileNotFoundError):
        readers.read_raw(spark, {})
    with pytest.raises(ValueError):
        readers.selected_columns({})


def test_filter_and_projection_reach_the_scan(spark, loans, tmp_path):
    path = str(tmp_path / "scan.parquet")
    loans.write.parquet(path)
    where = F.col("day") >= F.lit("2024-02-01").cast("timestamp_ntz")
    plan = readers.fetch(spark, {"type": "parquet", "path": path}, ["id"], where)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in text and "amount" not in text


def test_since_value_and_filter():
    assert ingest.since_value("2024-01-05", "2025-01-01", None, 2) == "2024-01-03T00:00:00"
    assert ingest.since_value(None, None, "2024-01-01") == "2024-01-01T00:00:00"
    assert ingest.since_value(None, "batch-7", "x", 2) == "batch-7"
    assert ingest.since_value(None, None, None) is None


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, v int")
    report = ingest.quality_gate(df, ["k"], "k")
    assert report["rows"] == 3 and report["duplicates"] == 1 and list(report["mostly_null"]) == ["v"]
    assert "v" not in ingest.quality_gate(df.union(df.select("k", F.lit(1))), [])["mostly_null"]
    with pytest.raises(ValueError, match="missing"):
        ingest.quality_gate(df, ["zz"])
    with pytest.raises(ValueError, match="empty"):
        ingest.quality_gate(df.limit(0))


def test_two_incremental_runs_keep_everything_once(spark, loans, tmp_path):
    src, raw, state = (str(tmp_path / n) for n in ("src.parquet", "raw.parquet", "state"))
    case = {
        "source": {"type": "parquet", "path": src},
        "ingestion": {"select_columns": ["id", "day", "amount"], "expected_columns": ["id"], "incremental_key": "day",
                      "incremental_start": "2024-01-01", "lookback_days": 2, "unique_key": "id"},
        "paths": {"raw_data": raw, "state": state},
    }
    loans.where("id < 50").write.parquet(src)
    first = ingest.ingest(spark, case)
    assert first["rows"] == 50 and first["mark"].startswith("2024-02-19")
    loans.where("id < 120").withColumn("amount", F.col("amount") + 1).write.mode("overwrite").parquet(src)
    second = ingest.ingest(spark, case)
    assert second["rows"] == 73
    stored = spark.read.parquet(raw)
    assert stored.count() == 120 and stored.select("id").distinct().count() == 120
    assert stored.where("amount = id * 1.5").count() == 47
    assert ingest.load_mark(spark, state).startswith("2024-04-29")
    assert ingest.save_mark(loans.limit(0), "day", state) is None
    assert ingest.load_mark(spark, str(tmp_path / "none")) is None


def test_write_formats(spark, loans, tmp_path):
    assert sinks.output_format({}, "a/b.csv") == "csv" and sinks.output_format({}, "a/b") == "parquet"
    with pytest.raises(ValueError):
        sinks.output_format({"write_format": "xml"}, "a")
    path = str(tmp_path / "out.csv")
    sinks.write_raw(loans, path, "csv")
    assert readers.read_csv(spark, {"path": path, "schema": "id long"}).count() == 120
    sinks.write_report(loans, str(tmp_path / "rep"), "json")
    assert spark.read.json(str(tmp_path / "rep")).count() == 120


def test_settle_broadcasts_only_below_its_bound(spark):
    small, large = settle(spark.range(5), rows=10), settle(spark.range(50), rows=10)
    assert small.count() == 5 and large.count() == 50
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small).lower() and "broadcast" not in plan(large).lower()
    assert shared_dir(spark)


RULES = [{"col": "amount", "op": ">", "threshold": 100}]


def score(df):
    share = rules.rule_columns(df, RULES, 1)["score"]
    cols = scoring.prediction_columns(share, F.col("id"), "late", 0.5, "v1", F.lit("2024-05-01").cast("timestamp_ntz"))
    return df.select("id", "day", *[c.alias(n) for n, c in cols.items()])


def test_stream_scores_equal_batch_and_resume(spark, loans, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    loans.where("id < 60").repartition(3).write.parquet(src)
    first = streams.stream_scores(spark, src, loans.schema, score, sink, check)
    assert first.count() == 60
    loans.where("id >= 60").write.mode("append").parquet(src)
    both = streams.stream_scores(spark, src, loans.schema, score, sink, check)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(both) == rows(score(loans))


def test_prediction_log_appends(spark, loans, tmp_path):
    log = str(tmp_path / "log")
    for part in ("id < 40", "id >= 40"):
        sinks.append_predictions(score(loans.where(part)), log)
    assert spark.read.parquet(log).count() == 120
    assert spark.read.parquet(log).select("prediction_id").distinct().count() == 120


def test_batch_size_check(loans):
    scoring.check_batch_size(loans, 120)
    with pytest.raises(ValueError):
        scoring.check_batch_size(loans, 119)


def test_stream_windows_equal_batch(spark, loans, tmp_path):
    src = str(tmp_path / "ev")
    events = loans.select(
        F.col("day").cast("timestamp").alias("ts"), (F.col("id") / 120).alias("s"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 3 == 0).cast("int")).alias("y"))
    events.repartition(4).write.parquet(src)
    stream = streams.read_files(spark, src, events.schema)
    months = streams.run_complete(
        streams.calendar_month_performance(stream, "ts", "s", "y", 0.5), str(tmp_path / "c1"), str(tmp_path / "t1"))
    batch = monitoring.performance_by_window(
        events.withColumn("window", F.date_format("ts", "yyyy-MM")), "window", "s", "y", 0.5).drop("roc_auc")
    cols = sorted(months.columns)
    near = lambda d: [[round(v, 9) if isinstance(v, float) else v for v in r]
                      for r in d.select(*cols).orderBy("window").collect()]
    assert near(months) == near(batch)
    counts = streams.run_complete(
        streams.windowed_score_counts(stream, "ts", "s", "y"), str(tmp_path / "c2"), str(tmp_path / "t2"))
    areas = streams.window_areas(counts)
    assert areas.count() == counts.select("window_start").distinct().count()


def test_stream_ingest_drops_repeats_however_late(spark, loans, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    run = lambda: streams.stream_ingest(spark, src, loans.schema, "id", "day", "2024-01-11", sink, check)
    loans.where("id < 80").write.parquet(src)
    assert run().count() == 70
    loans.where("id < 30 or id >= 60").write.mode("append").parquet(src)
    again = run()
    assert again.count() == 110 and again.select("id").distinct().count() == 110
