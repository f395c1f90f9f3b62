"""Temporal and hashed splits, folds and repeated shuffles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.functions.expressions import HASH_MODULUS, as_timestamp, key_hash, order_number
from lendscope.operators.running import running_totals
from lendscope.sources.workspace import ensure_checkpoint_dir, settle

#: Buckets of hash values that are counted per repeat, and rows of one hash at a cut that are told apart by their keys on the driver.
HASH_BUCKETS, MOST_ALIKE = 1024, 1000


def temporal_split(df: DataFrame, date_col: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the cutoff month, and rows after it. Undated rows are in neither."""
    start_of_next = F.add_months(F.lit(f"{cutoff}-01").cast("date"), 1).cast("timestamp_ntz")
    ts = as_timestamp(df, date_col)
    return df.where(ts < start_of_next), df.where(ts >= start_of_next)


def hash_slices(
    df: DataFrame,
    key: str,
    cuts: Callable[[Column], Sequence[Column]],
    by: Sequence[str] = (),
    seed: int | Column = 42,
    out: str = "slice",
) -> DataFrame:
    """Number each row by the slice of its group's hash order it falls in.

    ``cuts`` maps a group's row count to ascending positions; slice ``i`` starts at the ``i``-th
    cut. Sizes are exact for a key of any type, also where it is missing or
    repeated (``order_number``). Hash counts (at most ``HASH_MODULUS`` per group) find the hash value at each cut; only rows carrying exactly that hash value are ranked by key, all others are placed
    by a comparison. Columns beside the key are read only where a key is missing, or repeats at a cut.
    """
    by = list(by)
    if out in df.columns:
        raise ValueError(f"the table has a column {out!r} already")
    missing = has_missing(df, key)
    tagged = df.withColumn("_hash", key_hash(order_number(df, key, missing), seed))
    counts = tagged.groupBy(*by, "_hash").agg(F.count(F.lit(1)).alias("rows"))
    ranked = running_totals(counts, "_hash", ["rows"], by, descending=False, levels=HASH_MODULUS,
                            window_rows=HASH_MODULUS)
    ranked = ranked.withColumn("total", F.sum("rows").over(W.partitionBy(*by)))
    at_cut = ranked.select(
        *by, "_hash", (F.col("cum_rows") - F.col("rows")).alias("before"), F.col("cum_rows").alias("after"),
        F.explode(F.array(*[c.cast("long") for c in cuts(F.col("total"))])).alias("cut"),
    ).where((F.col("before") < F.col("cut")) & (F.col("cut") <= F.col("after")))
    # A cut at position c puts the first c rows below it, so the c-th row decides the hash value.
    ordered = F.sort_array(F.collect_list(
        F.struct("cut", F.col("_hash").alias("hash"), (F.col("cut") - F.col("before")).alias("keep"))))
    marks = settle(at_cut.groupBy(*by).agg(ordered.alias("_m")).select(
        *by, F.transform("_m", lambda m: m["hash"]).alias("_hashes"),
        F.transform("_m", lambda m: m["keep"]).alias("_keeps"),
    ))
    if by:
        on = [tagged[c].eqNullSafe(marks[c]) for c in by]
        joined = tagged.join(marks, on, "left").select(*[tagged[c] for c in tagged.columns], "_hashes", "_keeps")
    else:
        row = marks.first() or {"_hashes": [], "_keeps": []}
        constant = lambda c: F.array(*[F.lit(v) for v in row[c]]).cast("array<bigint>")
        joined = tagged.withColumns({"_hashes": constant("_hashes"), "_keeps": constant("_keeps")})
    on_edge = F.coalesce(F.array_contains("_hashes", F.col("_hash")), F.lit(False))
    clear = joined.where(~on_edge).withColumn("_rank", F.lit(0))
    edge = joined.where(on_edge)
    alike = missing or not edge.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").isEmpty()
    rest = [F.col(f"`{c}`") for c in df.columns if c != key] if alike else []
    edge = edge.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "_hash").orderBy(key, *rest)))
    most = len(cuts(F.lit(1)))
    passed = " + ".join(["0", *[
        f"IF(get(_hashes, {i}) < _hash OR (get(_hashes, {i}) = _hash AND _rank > get(_keeps, {i})), 1, 0)"
        for i in range(most)
    ]])
    return clear.unionByName(edge).select(*df.columns, F.expr(passed).alias(out))


def has_missing(df: DataFrame, key: str) -> bool:
    return df.schema[key].nullable and not df.where(F.col(f"`{key}`").isNull()).select(key).isEmpty()


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Random train and test rows with the same class shares."""
    cut = lambda n: [F.round(n * F.lit(float(test_size)))]
    sliced = hash_slices(df, key, cut, [label], seed, "_slice")
    return (
        sliced.where("_slice = 1").drop("_slice"),
        sliced.where("_slice = 0").drop("_slice"),
    )


def split_frame(df: DataFrame, spec: dict, event: str) -> tuple[DataFrame, DataFrame]:
    kind = spec.get("type", "temporal")
    if kind == "temporal":
        return temporal_split(df, spec["date_col"], spec["train_cutoff"])
    if kind == "random":
        return stratified_split(
            df, spec["key"], event, float(spec.get("test_size", 0.2)), int(spec.get("random_state", 42))
        )
    raise ValueError(f"unknown split type {kind!r}; known: temporal, random")


def split_report(parts: dict[str, DataFrame], event: str) -> DataFrame:
    """Rows, share of all rows and event rate of each part."""
    frames = [d.select(F.lit(name).alias("split"), F.col(event).alias("event")) for name, d in parts.items()]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    sizes = stacked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("event").alias("event_rate"))
    return sizes.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def fold_starts(folds: int) -> Callable[[Column], list[Column]]:
    """Cut positions of near-equal folds; the first ``n mod folds`` folds get one row more."""
    return lambda n: [
        F.lit(i) * F.floor(n / folds) + F.least(F.lit(i).cast("long"), n % folds) for i in range(1, folds)
    ]


def folds(df: DataFrame, key: str, k: int, strata: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Add ``fold`` (0-based): shuffled, and class-wise when ``strata`` is given."""
    return hash_slices(df, key, fold_starts(k), strata, seed, "fold")


def shuffle_cuts(rows: int, sizes: Sequence[float], test_size: float) -> list[int]:
    """Rows below the end of the test part, and below the end of each training part but the last."""
    test = math.ceil(rows * float(test_size))
    return [test] + [test + math.floor((rows - test) * float(s)) for s in sizes[:-1]]


def shuffle_parts(
    df: DataFrame, key: str, repeats: int, sizes: Sequence[float], test_size: float = 0.2, seed: int = 42, out: str = "parts",
) -> DataFrame:
    """Add an array with the row's part in every repeat: 0 = test, ``i`` = enters training at size ``i``.

    Rows are not copied. Of each repeat only the hash of the key is counted: first by buckets of hash values, then by value in the
    few buckets that hold a cut. What comes back are the values at the cuts, a few per repeat, and each row compares its own hashes
    with them (``_part_numbers``). Keys that share the hash at a cut are told apart by the key; where keys are missing, or repeat at a cut, whole rows
    must be, and the copies of ``hash_slices`` do that.
    """
    if out in df.columns:
        raise ValueError(f"the table has a column {out!r} already")
    total = df.count()
    cuts = sorted({c for c in shuffle_cuts(total, sizes, test_size) if c > 0})
    if has_missing(df, key):
        return _parts_from_copies(df, key, repeats, sizes, test_size, seed, out)
    number = order_number(df, key, whole_row=False)
    each = df.select(F.col(f"`{key}`").alias("_key"), number.alias("_number"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"))
    hashed = each.select("_key", "_number", "_r", key_hash(F.col("_number"), F.lit(seed + 1) + F.col("_r")).alias("_hash"))
    width = -(-HASH_MODULUS // HASH_BUCKETS)
    coarse = hashed.groupBy("_r", F.floor(F.col("_hash") / width).cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    wanted: dict[tuple[int, int], int] = {}
    sofar: dict[int, int] = {}
    for r in sorted(coarse.collect(), key=lambda r: (r["_r"], r["_b"])):  # at most HASH_BUCKETS counts a repeat
        low = sofar.get(r["_r"], 0)
        sofar[r["_r"]] = low + r["n"]
        if any(low < c <= low + r["n"] for c in cuts):
            wanted[r["_r"], r["_b"]] = low
    code = (F.floor(F.col("_hash") / width).cast("int") * (HASH_BUCKETS * 2) + F.col("_r")).cast("int")
    fine = hashed.where(code.isin([b * HASH_BUCKETS * 2 + r for r, b in wanted])).groupBy("_r", "_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
    marks: list[list[tuple[int, int, int]]] = [[] for _ in range(repeats)]  # (hash, rows of it below the cut, its rows)
    running, last = 0, None
    for r in sorted(fine.collect(), key=lambda r: (r["_r"], r["_hash"])):  # the rows of a few buckets out of many
        place = (r["_r"], r["_hash"] // width)
        running = wanted[place] if place != last else running
        last = place
        marks[r["_r"]] += [(r["_hash"], c - running, r["n"]) for c in cuts if running < c <= running + r["n"]]
        running += r["n"]
    shared = {(r, h) for r, own in enumerate(marks) for h, below, n in own if below < n}
    ends: dict[tuple[int, int], list] = {}
    if shared:
        if max(n for own in marks for _, _, n in own) > MOST_ALIKE:
            return _parts_from_copies(df, key, repeats, sizes, test_size, seed, out)
        pairs = df.sparkSession.createDataFrame(sorted(shared), "_r int, _hash long")
        for r in hashed.join(F.broadcast(pairs), ["_r", "_hash"]).select("_r", "_hash", "_key", "_number").collect():
            ends.setdefault((r["_r"], r["_hash"]), []).append((r["_key"], r["_number"]))
        if any(len(set(values)) < len(values) for found in ends.values() for values in zip(*found)):
            return _parts_from_copies(df, key, repeats, sizes, test_size, seed, out)
    # Per repeat the hashes at the cuts, and for a shared one the numbers of the keys above the cut.
    every, above = shuffle_cuts(total, sizes, test_size), []
    for r, own in enumerate(marks):
        late = [(h, [number for _, number in sorted(ends[r, h])[below:]]) for h, below, n in own if below < n]
        above.append((sorted(h for h, _, _ in own), late))
    # Cuts at 0 rows stand below every row; equal cuts count as often as they occur.
    steps = [sum(c <= 0 or c in cuts[:i] for c in every) for i in range(len(cuts) + 1)]
    hashes = F.array(*[F.coalesce(key_hash(number, seed + 1 + r), F.lit(-1).cast("long")) for r in range(repeats)])
    return df.select(*[F.col(f"`{c}`") for c in df.columns], _part_numbers(above, steps)(number, hashes).alias(out))


def _part_numbers(above: Sequence[tuple], steps: Sequence[int]):
    """The parts in all repeats from a key's number and its hashes. As arguments of a function the hashes are compiled in pieces: many
    of them, and comparisons with all cuts, in one scan make a method that is too long for the JVM to compile."""

    def parts(number: pa.Array, hashes: pa.Array) -> pa.Array:
        own = hashes.flatten().to_numpy(zero_copy_only=False).reshape(len(number), -1)
        found = np.empty((len(number), len(above)), np.int32)
        for r, (cuts, late) in enumerate(above):
            place = np.searchsorted(np.array(cuts, np.int64), own[:, r], "left")
            for value, numbers in late:
                same = np.flatnonzero(own[:, r] == value)
                if len(same):
                    place[same] += np.isin(number.take(pa.array(same)).to_numpy(zero_copy_only=False), numbers)
            found[:, r] = np.array(steps, np.int32)[place]
        return pa.ListArray.from_arrays(np.arange(len(number) + 1, dtype=np.int32) * len(above), found.ravel())

    return F.arrow_udf(parts, "array<int>")


def _parts_from_copies(df: DataFrame, key: str, repeats: int, sizes, test_size: float, seed: int, out: str) -> DataFrame:
    marked = df.withColumn("_row", F.monotonically_increasing_id())
    ensure_checkpoint_dir(df.sparkSession)
    marked = marked.checkpoint()
    parts = _copies(marked, key, repeats, sizes, test_size, seed).groupBy("_row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("repeat", "part"))), lambda x: x["part"]).alias(out))
    return marked.join(parts, "_row").select(*[F.col(f"`{c}`") for c in df.columns], out)


def repeated_shuffles(
    df: DataFrame, key: str, repeats: int, sizes: Sequence[float], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """One copy of each row per repeat with ``part``, see ``shuffle_parts``."""
    marked = shuffle_parts(df, key, repeats, sizes, test_size, seed, "_parts")
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], F.posexplode("_parts").alias("repeat", "part")).withColumn(
        "repeat", F.col("repeat") + 1)


def _copies(df: DataFrame, key: str, repeats: int, sizes: Sequence[float], test_size: float, seed: int) -> DataFrame:
    copies = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def cuts(n: Column) -> list[Column]:
        test = F.ceil(n * F.lit(float(test_size)))
        train = n - test
        return [test] + [test + F.floor(train * F.lit(float(s))) for s in sizes[:-1]]

    return hash_slices(copies, key, cuts, ["repeat"], F.lit(seed) + F.col("repeat"), "part")
