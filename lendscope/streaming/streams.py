"""Scoring, monitoring and ingestion as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.functions.expressions import month_key
from lendscope.operators.metrics import CURVE_NAMES, curve_areas
from lendscope.operators.monitoring import window_aggregates, with_window_rates
from lendscope.operators.running import running_totals
from lendscope.sources.sinks import MONTH, UNDATED
from lendscope.sources.workspace import work_path
from lendscope.streaming.first_rows import first_of_batch, keyed_state, marked_rows

SCORE_DIGITS = 3
BATCH = "part_batch"
#: Fixed value: the column property by which Spark knows an event time and its allowed lateness (milliseconds).
WATERMARK = "spark.watermarkDelayMs"


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream the files of a folder, or one file ending in ``.parquet``; at most ``files_per_batch`` at a time.

    A file stream takes a plain path for a folder; written as a pattern it may also be a single file.
    """
    if path.endswith(".parquet"):
        path = path[:-1] + "[t]"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> None:
    """Process everything available, appending parquet files exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(partition) if partition else writer
    writer.trigger(availableNow=True).start(path).awaitTermination()


def stream_scores(
    spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> DataFrame:
    """Score arriving rows with the same transforms as a batch; returns the log written so far.

    ``score`` must be row-wise: fitted parameters are fixed before the stream starts.
    """
    scored = score(read_files(spark, source, schema))
    run_to_files(scored, sink, checkpoint)
    return spark.read.schema(scored.schema).parquet(sink)


def windowed_performance(
    stream: DataFrame, ts: str, score: str, actual: str, threshold: float,
    length: str = "10 days", lateness: str = "1 day",
) -> DataFrame:
    """Score distribution and label counts per fixed window.

    The event time must be a zoned timestamp, as watermarks require. In update mode (``run_updates``) a window leaves the
    state once the watermark, ``lateness`` behind the latest event, has passed its end, and rows for it that come
    later are dropped. Complete mode keeps every window and drops nothing.
    """
    windows = stream.withWatermark(ts, lateness).groupBy(F.window(ts, length).alias("w"))
    found = with_window_rates(windows.agg(*window_aggregates(threshold, score, actual)))
    return found.withColumn("window_start", F.date_format("w.start", "yyyy-MM-dd")).drop("w")


def windowed_score_counts(
    stream: DataFrame, ts: str, score: str, actual: str, length: str = "10 days", lateness: str = "1 day",
    digits: int | None = SCORE_DIGITS,
) -> DataFrame:
    """Events and other rows per window and score, from which the areas follow.

    Rounding to ``digits`` bounds the state by open windows times distinct rounded scores; None keeps scores as they are.
    """
    rounded = F.col(score) if digits is None else F.round(F.col(score), digits)
    rows = stream.where(F.col(score).isNotNull() & F.col(actual).isNotNull())
    counts = rows.withWatermark(ts, lateness).groupBy(F.window(ts, length).alias("w"), rounded.alias("score")).agg(
        F.sum(F.col(actual).cast("long")).alias("pos"), F.sum(1 - F.col(actual).cast("long")).alias("neg")
    )
    return counts.withColumn("window_start", F.date_format("w.start", "yyyy-MM-dd")).drop("w")


def calendar_month_performance(
    stream: DataFrame, ts: str, score: str, actual: str, threshold: float, lateness: str = "1 day",
) -> DataFrame:
    """The same aggregates per calendar month; run in update or complete mode.

    Months are of uneven length, so no window function makes them. The grouping key is the instant at which a month ends, and it
    is marked as an event time: in update mode a month leaves the state once the watermark, ``lateness`` behind
    the latest event, has reached that instant, and rows for it that come later are dropped. The state holds the
    months still open. Rows without a time have no month and are left out. Complete mode keeps every month and drops nothing.
    """
    marked = stream.withWatermark(ts, lateness)
    delay = marked.select(ts).schema[0].metadata[WATERMARK]
    start = F.date_trunc("month", F.col(ts))
    end = (start + F.expr("INTERVAL 1 MONTH")).alias("_end", metadata={WATERMARK: delay})
    months = marked.where(F.col(ts).isNotNull()).select(end, *{score, actual}).groupBy("_end").agg(
        *window_aggregates(threshold, score, actual))
    found = with_window_rates(months)
    return found.withColumn("window", F.date_format(F.col("_end") - F.expr("INTERVAL 1 MONTH"), "yyyy-MM")).drop("_end")


def run_complete(result: DataFrame, checkpoint: str, target: str) -> DataFrame:
    """Process everything available and return the full result table.

    The result of each micro-batch replaces the table of the one before under ``target``.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(keep).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = result.sparkSession
    table = spark.read.schema(_with_field(result.schema, "batch", T.LongType())).parquet(target)
    last = table.agg(F.max("batch")).first()[0]
    return table.where(F.col("batch") == F.lit(last)).drop("batch")


def run_updates(result: DataFrame, keys: Sequence[str], checkpoint: str, target: str) -> DataFrame:
    """Process everything available in update mode and return the latest row of every key.

    A micro-batch writes only the rows it changed, under its own number, so a repeated batch replaces itself
    and the state holds no more than the open windows. The highest batch number of a key is its latest row.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(keep).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table = result.sparkSession.read.schema(_with_field(result.schema, "batch", T.LongType())).parquet(target)
    rest = [c for c in result.columns if c not in keys]
    latest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in result.columns])


def window_areas(score_counts: DataFrame) -> DataFrame:
    """ROC-AUC and average precision per window from the streamed score counts."""
    cum = running_totals(score_counts, "score", ["pos", "neg"], ["window_start"])
    return curve_areas(cum.withColumnsRenamed(CURVE_NAMES), ["window_start"])


def stream_ingest(
    spark: SparkSession, source: str, schema, key: str, ts: str, since: str | None, sink: str, checkpoint: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Pick up files that arrived since the last run, each key once, into a month-partitioned table.

    The rule is that of the batch merge (``one_per_key``): a stored key keeps its row, of several new rows the earliest
    stays, and rows without a key are all kept. Stored keys live in the query's state, so a batch costs what its own
    rows cost, however large the table is. Keys of rows that lay in ``sink`` before the first run are listed beside the checkpoint
    and count as stored; from then on the stream is the table's only writer. A batch that is run again after a failure takes up its state before it and
    replaces the files of its own number, so nothing is added twice.
    """
    rows = read_files(spark, source, schema, files_per_batch)
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since).cast(rows.schema[ts].dataType))
    rows = rows.withColumn(MONTH, F.coalesce(month_key(F.col(ts)), F.lit(UNDATED)))
    kept = _with_field(rows.schema, BATCH, T.StringType())
    run = sha256(checkpoint.encode()).hexdigest()[:16]
    known, keys = f"{checkpoint}/known", T.StructType([rows.schema[key]])
    if not _exists(spark, f"{checkpoint}/metadata"):  # written as the query starts; a list of keys without it is not in use yet
        own = F.col("_metadata.file_path").contains(f"/{BATCH}={run}-")  # of a checkpoint that was taken away
        stored = read_table(spark, kept, sink).where(~own).select(f"`{key}`") if _exists(spark, sink) else spark.createDataFrame([], keys)
        stored.distinct().write.format("parquet").mode("overwrite").save(known)

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = first_of_batch(batch, key, ts).withColumn(BATCH, F.lit(f"{run}-{batch_id}"))
        writer = fresh.hint("rebalance", MONTH).write.partitionBy(MONTH, BATCH).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(sink)

    with keyed_state(spark):
        marked = marked_rows(rows, key, read_files(spark, known, keys))
        running = marked.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return read_table(spark, kept, sink).drop(MONTH, BATCH)


def read_table(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Files at any depth of partitions: those of the stream lie one folder below those of a batch merge."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """A sink and a checkpoint folder for one run, in the shared folder."""
    base = work_path(spark, name)
    return f"{base}/data", f"{base}/checkpoint"


