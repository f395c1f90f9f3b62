"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.sources.workspace import work_path

#: The white space of the contracts, as a regular expression class and as bytes.
BLANK = r"[\x20\x09-\x0D]"
BLANK_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again: lineage ends, retries read the same."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for the session's Python workers: texts are long, and a batch is held
    on both sides. Their bytes are bounded by Spark's own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def clear_worker() -> None:
    """Free what earlier tasks of a reused Python worker left: code shipped by value comes anew with every task, and
    what it refers to lies in reference cycles."""
    import gc

    gc.collect()


def bounded(texts: Sequence[str], most: int) -> list[slice]:
    """Consecutive parts of at most ``most`` characters, or of one longer text."""
    parts, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            parts.append(slice(begin, i))
            begin, size = i, 0
        size += len(t)
    return parts + [slice(begin, len(texts))] if len(texts) > begin else parts


def thinned(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About 1.25 times ``rows`` rows chosen by a hash of the key, or all if there are few: what a top-``rows`` by the
    same hash needs, so that no task sends more than its share to the driver."""
    total = df.count()
    share = 1.25 * rows / total if total else 1.0
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))


def full_text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def blank_free(text: Column) -> Column:
    return F.regexp_replace(text, BLANK + "+", "")


def in_fold(doc_id: Column | str, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held`` modulo ``folds``; a null id is never held out."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None).cast("long"))
    return F.coalesce(F.crc32(text.cast("string").cast("binary")) % folds == held, F.lit(False))
