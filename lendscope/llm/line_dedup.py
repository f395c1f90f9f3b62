"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import BLANK_BYTES, clear_worker, saved, small_batches

LEAST = 10
#: Batches of a table, and runs of one level that are merged into one of the next.
BATCHES, FANOUT = 4, 2


def line_hashes(text: str | None, least: int = LEAST) -> list[bytes | None]:
    """128-bit hash of the key of every line; None for keys of fewer than ``least`` code points.

    A key is the line without white space at its ends, with A to Z in lower case.
    """
    found: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(BLANK_BYTES).lower()  # bytes: ASCII letters only
        short = len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least
        found.append(None if short else hashlib.blake2b(key, digest_size=16).digest())
    return found


class LevelledRuns:
    """Runs of (hash, owner), each sorted by hash and without a hash of another run.

    A new run enters level 0. When a level holds ``fanout`` runs, they are merged into one run of the next
    level, so after n batches about ``fanout`` times log n runs are joined, and each hash is
    rewritten about log n times.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, fresh: DataFrame) -> None:
        """Anti-join a batch (hash, owner) with every run, largest first, and store what is new as a run."""
        for run in reversed(self.runs()):
            fresh = fresh.join(run.hint("merge"), "hash", "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run = saved(rows.repartitionByRange("hash").sortWithinPartitions("hash"), f"line-run-{level}")
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level]
            self.levels[level] = []
            whole = merged[0]
            for other in merged[1:]:
                whole = whole.union(other)
            self._put(level + 1, whole)


def first_owners(lines: DataFrame, batches: int, fanout: int) -> LevelledRuns:
    """Runs of the smallest id that holds each hash, fed with ``batches`` ranges of rising ids."""
    bounds = lines.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (bounds.low, bounds.high) if bounds.low is not None else (0, 0)
    width = (high - low) // batches + 1
    part = F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(batches)).cast("int")  # null ids last
    grouped = lines.groupBy(part.alias("part"), "hash").agg(F.min("doc_id").alias("owner"))
    grouped = saved(grouped, "line-batches")
    runs = LevelledRuns(fanout)
    present = sorted(r.part for r in grouped.select("part").distinct().collect())
    for number in present:
        runs.add(grouped.filter(F.col("part") == number).select("hash", "owner"))
    return runs


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: every line whose key a smaller id holds is dropped.

    Null and empty texts are one empty line; keys shorter than ``least`` code points are never dropped; repeats
    inside the first document stay. Rows that share an id count as one document. A null id comes after all
    others; rows without an id count as one document. An empty table gives an empty result.

    Documents enter as ``batches`` ranges of rising ids. Each batch is joined against the sorted runs of line
    hashes gathered so far, and its new hashes form a run, so a hash is owned by the first batch that has it. A hot line
    is one row per batch before any join.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def hashes(batches):
        import pyarrow as pa

        clear_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                places, found = [], []
                for place, text in enumerate(batch.column(1).to_pylist()):
                    own = {h for h in line_hashes(text, least) if h is not None}
                    places += [place] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places, pa.int64())), pa.array(found, pa.binary())], ["doc_id", "hash"])

    lines = saved(base.mapInArrow(hashes, f"doc_id {kind}, hash binary"), "line-hashes")
    drops = None
    for run in first_owners(lines, batches, fanout).runs():
        later = lines.join(run.hint("merge"), "hash").filter(
            F.col("doc_id").isNull() & F.col("owner").isNotNull() | (F.col("owner") < F.col("doc_id")))
        later = later.select("doc_id", "hash")
        drops = later if drops is None else drops.union(later)
    if drops is None:
        drops = lines
    drops = drops.groupBy("doc_id").agg(F.collect_set("hash").alias("dropped"))

    @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
    def rebuild(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        rows = []
        for t, gone in zip(text, dropped):
            t = t or ""
            lines = t.split("\n")
            if gone is None or not len(gone):
                rows.append((len(lines), 0, t))
                continue
            gone = set(map(bytes, gone))
            kept = [line for line, h in zip(lines, line_hashes(t, least)) if h is None or h not in gone]
            rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_text"])

    joined = base.join(drops.withColumnRenamed("doc_id", "drop_id"), F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    return joined.select("doc_id", rebuild("text", "dropped").alias("r")).select("doc_id", "r.*")
