"""Update mode: closed windows leave the state, and late rows for them are dropped."""

from datetime import datetime

from lendscope.streaming import streams

SCHEMA = "ts timestamp, score double, actual int"


def arrive(spark, path, days):
    rows = [(datetime(2025, 1, d), 0.5 + d / 100, d % 2) for d in days]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_closed_windows_leave_the_state(spark, tmp_path):
    source, check, target = (str(tmp_path / n) for n in ("in", "check", "out"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        stream = streams.read_files(spark, source, schema)
        result = streams.windowed_performance(stream, "ts", "score", "actual", 0.6, "5 days", "1 day")
        found = streams.run_updates(result, ["window_start"], check, target)
        return {r["window_start"]: r["n"] for r in found.collect()}

    arrive(spark, source, [1, 2, 3])
    first = run()
    arrive(spark, source, [20, 21])
    arrive_counts = run()
    assert set(first) < set(arrive_counts) and sum(arrive_counts.values()) == 5
    arrive(spark, source, [2, 22])  # the window of day 2 is closed: its row is dropped, day 22 counts
    late = run()
    assert sum(late.values()) == 6 and all(late[w] == n for w, n in first.items())
    written = spark.read.parquet(target)
    assert written.select("batch").distinct().count() >= 3
    last = written.agg({"batch": "max"}).first()[0]
    assert written.where(written["batch"] == last).count() <= 1  # only what the last batch changed is written


def state_rows(spark, check):
    """Keys in the last version of the query's state."""
    return spark.read.format("statestore").load(check).count()


def test_closed_months_leave_the_state(spark, tmp_path):
    """February, March and April are of different lengths; a late row counts until its month is closed, and not after."""
    source, check, target = (str(tmp_path / n) for n in ("in", "check", "out"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(*moments):
        rows = [(m and datetime(2024, *m), 0.7, 1) for m in moments]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, schema)
        result = streams.calendar_month_performance(stream, "ts", "score", "actual", 0.6, "2 days")
        found = streams.run_updates(result, ["window"], check, target)
        return {r["window"]: r["n"] for r in found.collect()}

    assert run((2, 1), (2, 29, 23, 59), (3, 1), None) == {"2024-02": 2, "2024-03": 1}
    assert state_rows(spark, check) == 2
    assert run((3, 2, 23), (2, 28)) == {"2024-02": 3, "2024-03": 2}  # two days late: February is still open
    assert run((3, 3, 1)) == {"2024-02": 3, "2024-03": 3}  # the watermark reaches 1 March: February is closed
    assert state_rows(spark, check) == 1
    assert run((2, 29), (3, 31, 23)) == {"2024-02": 3, "2024-03": 4}  # its late row is dropped
    assert run((4, 30, 12), (3, 31)) == {"2024-02": 3, "2024-03": 5, "2024-04": 1}
    assert run((6, 15)) == {"2024-02": 3, "2024-03": 5, "2024-04": 1, "2024-06": 1}
    assert state_rows(spark, check) == 1
