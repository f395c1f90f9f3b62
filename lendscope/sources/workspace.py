"""The shared folder for checkpoints and intermediate tables, and size-checked small tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SMALL_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which every executor must reach."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(
            f"set {CHECKPOINT_SETTING} to a folder every executor can reach; "
            "a machine-local folder would be lost with its machine"
        )
    return named


def use_local_folder(spark: SparkSession) -> None:
    """For tests and benchmarks: give a local session that names no folder a temporary one."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lendscope-"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table of this application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def settle_local(df: DataFrame, rows: int = SMALL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """Compute a table that is expected to be small, once, and cut its lineage.

    Up to ``rows`` rows it comes back as a local table marked for broadcast, together with its
    Arrow form. Beyond that it is checkpointed in the shared folder and left unmarked, so that
    Spark sizes the join itself.
    """
    spark = df.sparkSession
    head = df.limit(rows + 1).toArrow()
    if head.num_rows <= rows:
        return F.broadcast(spark.createDataFrame(head, df.schema)), head
    ensure_checkpoint_dir(spark)
    return df.checkpoint(), None


def settle(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    return settle_local(df, rows)[0]
