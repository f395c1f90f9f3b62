"""Classification trees of many fits, grown together: a level of all of them is one scan of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (node, feature, bin, class) that a task sums at once, feature slots that are binned at most, rows a task reads at least on a
#: large table (its sums are of one size however many rows it has), rows that are folded at a time, and bytes a task holds back.
MOST_CELLS, MOST_SLOTS, TASK_ROWS, FOLD_ROWS, HELD_BYTES = 4_000_000, 1_000, 2_000_000, 8_192, 16 << 20
#: Rows that candidate cuts are taken from, as in Spark's own trees: all of a smaller fit.
CUT_ROWS = 10_000
#: Weights of the two classes that differ by less, in parts of their size, are equal.
SAME = 1e-9


@dataclass
class Fit:
    """Rows of ``repeat`` whose part is 1 to ``size``: ``counts`` of the two classes, each row with its class's weight."""

    repeat: int
    size: int
    counts: tuple[int, int]
    weights: tuple[float, float]
    nodes: list[Node] = field(default_factory=list, repr=False)
    seconds: float = 0.0


@dataclass
class Node:
    """A leaf until ``low`` and ``high`` are set: rows whose code of ``feature`` is ``cut`` or less go to ``low``."""

    counts: tuple[int, int]
    feature: int = -1
    cut: int = 0
    low: int = 0
    high: int = 0


def are_numbers(rows: DataFrame, features: str) -> bool:
    """Whether no slot of the vector is marked as a category, which Spark's trees split by sets of values."""
    marked = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return not set(marked) & {"nominal", "binary"}


def part_counts(rows: DataFrame, label: str, repeats: int) -> tuple[np.ndarray, bool]:
    """Rows per (repeat, part, class), and whether every label is 0 or 1. A task sends one row, whatever the rows it reads."""

    def run(batches: Iterator):
        import pyarrow as pa

        sums, others = np.zeros((repeats, 128, 2), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            parts = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            known = (y > -1) & (y < 2)
            others += int(np.sum((y != 0) & (y != 1)))
            cells = 2 * parts[known] + y[known].astype(np.int64)[:, None]
            for repeat in range(repeats):
                sums[repeat] += np.bincount(cells[:, repeat], minlength=256).reshape(128, 2)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([others], pa.int64())], ["sums", "others"])

    found = rows.select(F.col(label).cast("double"), "parts").mapInArrow(run, "sums binary, others long").collect()
    sums = sum((np.frombuffer(r["sums"], np.int64).reshape(repeats, 128, 2) for r in found), np.zeros((repeats, 128, 2), np.int64))
    return sums, not any(r["others"] for r in found)


def chosen_rows(fits: Sequence[tuple], slots: int, seed: int):
    """A task's rows for the candidate cuts: ``(fit, y, rows)``, class and values as bytes, of every fit's share of rows."""
    held_bytes = HELD_BYTES

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, size = {}, 0

        def out():
            found = [(k, b"".join(y), b"".join(v)) for k, (y, v) in sorted(held.items())]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["fit", "y", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            parts = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for k, (repeat, last, share) in enumerate(fits):
                used = np.flatnonzero((parts[:, repeat] > 0) & (parts[:, repeat] <= last))
                if share < 1:
                    used = used[draw.random(len(used)) < share]
                if len(used):
                    own = held.setdefault(k, ([], []))
                    own[0].append(y[used].tobytes())
                    own[1].append(values[used].tobytes())
                    size += len(used) * (8 * slots + 1)
                if size >= held_bytes:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


def cuts_of(weights: Sequence[tuple[float, float]], bins: Sequence[int], slots: int):
    """Candidate cuts of one fit from its chosen rows, as Spark's trees place them: between all distinct values where they are few,
    else where the weight below comes nearest to even shares."""

    def run(table):
        import pyarrow as pa

        fit = table.column("fit")[0].as_py()
        y = np.frombuffer(b"".join(table.column("y").to_pylist()), np.int8)
        values = np.frombuffer(b"".join(table.column("rows").to_pylist())).reshape(-1, slots)
        weight, most, found = np.array(weights[fit]), bins[fit] - 1, []
        for f in range(slots):
            distinct, place = np.unique(values[:, f], return_inverse=True)
            middles = (distinct[:-1] + distinct[1:]) / 2.0
            if len(middles) > most:
                below = np.cumsum(np.bincount(place, y == 0) * weight[0] + np.bincount(place, y == 1) * weight[1])
                nearer, stride = (below[:-1] + below[1:]) / 2, below[-1] / (most + 1)
                target, at, taken = stride, 0, []
                while (at := max(at, int(np.searchsorted(nearer, target, "right")))) < len(nearer):
                    taken.append(at)
                    target, at = target + stride, at + 1
                middles = middles[taken]
            found.append(np.unique(middles).tolist())
        return pa.table({"fit": pa.array([fit], pa.int32()), "cuts": pa.array([found], pa.list_(pa.list_(pa.float64())))})

    return run


def coded(every: Sequence[np.ndarray], kind: str):
    """A task's rows with the number of known cuts below each value, for all fits alike."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.column_stack([np.searchsorted(cuts, values[:, f], "left") for f, cuts in enumerate(every)]).astype(kind)
            parts = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int8)
            rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows(codes), batch.column(1).cast(pa.int8()), rows(parts), pa.array(np.arange(len(codes)), pa.int32())], ["codes", "y", "parts", "spread"])

    return run


def repeats_of(starts: np.ndarray, kind: str):
    """Reader of coded batches: per some rows and repeat ``(repeat, codes, y, ends)``, rows in the order of their part, which ends at
    ``ends[part]``. Codes are counted on over all features, from ``starts``. (A closure: workers need no copy of this package.)"""
    fold_rows = FOLD_ROWS

    def read(batches: Iterator, repeats: Sequence[int]):
        def folded():
            held = []
            for batch in batches:
                held.append([b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False), b"".join(batch.column(2).to_pylist())])
                if sum(len(h[1]) for h in held) >= fold_rows:
                    yield held
                    held = []
            if any(len(h[1]) for h in held):
                yield held

        for some in folded():
            y = np.concatenate([h[1] for h in some]).astype(np.int32)
            codes = np.frombuffer(b"".join(h[0] for h in some), kind).reshape(len(y), -1) + starts
            parts = np.frombuffer(b"".join(h[2] for h in some), np.int8).reshape(len(y), -1)
            for repeat in repeats:
                order = np.argsort(parts[:, repeat], kind="stable")
                yield repeat, codes.take(order, axis=0), y.take(order), np.cumsum(np.bincount(parts[:, repeat], minlength=128))

    return read


def leaves_of():
    """Walk of rows down a tree's arrays ``(feature, cut, low, high)`` in so many steps."""

    def walk(tree: Sequence[np.ndarray], steps: int, codes: np.ndarray) -> np.ndarray:
        feature, cut, low, high = tree
        node, flat, row = np.zeros(len(codes), np.int64), codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        for _ in range(steps):
            of = feature[node]
            node = np.where(of < 0, node, np.where(flat[row + of] <= cut[node], low[node], high[node]))
        return node

    return walk


def summed(read, fits: Sequence[tuple], every: Sequence[np.ndarray], starts: np.ndarray, offsets: np.ndarray, width: int):
    """A task's share of a level: ``(fit, cells, seconds)``, rows per (node of the frontier, feature, bin, class) as 32-bit numbers."""
    walk = leaves_of()

    def run(batches: Iterator):
        import time

        import pyarrow as pa

        work, total = {}, 0
        for k, repeat, size, cuts, tree, steps, frontier in fits:
            codes = np.concatenate([offsets[f] + 2 * np.r_[0, np.searchsorted(own, every[f], "right")] for f, own in enumerate(cuts)]).astype(np.int32)
            place = np.full(len(tree[0]), -1, np.int32)
            place[frontier] = np.arange(len(frontier)) * width
            work.setdefault(repeat, []).append([k, size, codes, tree, steps, place, np.zeros(len(frontier) * width, np.int64), 0.0])
        for repeat, codes, y, ends in read(batches, list(work)):
            for fit in work[repeat]:
                _, size, bins, tree, steps, place, sums, _ = fit
                began = time.perf_counter()
                own, label = codes[ends[0]:ends[size]], y[ends[0]:ends[size]]
                at = place[walk(tree, steps, own)]
                if (at < 0).any():
                    used = np.flatnonzero(at >= 0)
                    own, label, at = own[used], label[used], at[used]
                if len(own):
                    cells = bins.take(own)
                    cells += (at + label)[:, None]
                    sums += np.bincount(cells.ravel(), minlength=len(sums))
                fit[-1] += time.perf_counter() - began
        found = [fit for some in work.values() for fit in some if fit[6].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[6].astype(np.int32).tobytes() for f in found], pa.binary()),
             pa.array([f[7] for f in found], pa.float64())], ["fit", "cells", "seconds"])

    return run


def best_cuts(fits: dict[int, tuple], offsets: np.ndarray, widths: np.ndarray, width: int, least: int):
    """The best cut of every frontier node of one fit from all tasks' sums: Gini gain, of equal ones the first feature's first."""

    def run(table):
        import pyarrow as pa

        fit = table.column("fit")[0].as_py()
        frontier, (w0, w1) = fits[fit]
        sums = np.zeros(len(frontier) * width, np.int64)
        for cells in table.column("cells"):
            sums += np.frombuffer(cells.as_buffer(), np.int32)
        sums = sums.reshape(len(frontier), width)
        gini = lambda a, b: 1.0 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2
        gains, sides, names = [], [], []
        for f, (offset, n) in enumerate(zip(offsets, widths)):
            own = sums[:, offset:offset + 2 * n].reshape(len(frontier), n, 2)
            low, all_ = np.cumsum(own, 1)[:, :-1], own.sum(1, keepdims=True)
            high = all_ - low
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b, c, d = low[..., 0] * w0, low[..., 1] * w1, high[..., 0] * w0, high[..., 1] * w1
                every = (a + b) + (c + d)
                gain = gini(all_[..., 0] * w0, all_[..., 1] * w1) - (a + b) / every * gini(a, b) - (c + d) / every * gini(c, d)
            gains.append(np.where((low.sum(2) >= least) & (high.sum(2) >= least), gain, -1.0))
            sides.append(low)
            names += [(f, i) for i in range(n - 1)]
        gain, low = np.concatenate(gains, 1), np.concatenate(sides, 1)
        rows = range(len(frontier) if names else 0)
        best = gain.argmax(1) if names else []
        seconds = np.r_[sum(table.column("seconds").to_pylist()), np.zeros(len(frontier))]
        out = [(fit, frontier[i], *names[best[i]], int(low[i, best[i], 0]), int(low[i, best[i], 1]), float(gain[i, best[i]]), float(seconds[i])) for i in rows]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.float64()] * 2
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["fit", "node", "feature", "bin", "low0", "low1", "gain", "seconds"])

    return run


def judged(read, fits: Sequence[tuple]):
    """A task's confusion counts as bytes: per fit (held out or learned from, predicted, actual), 64-bit numbers."""
    walk = leaves_of()

    def run(batches: Iterator):
        import pyarrow as pa

        work, counts = {}, np.zeros((len(fits), 8), np.int64)
        for k, (repeat, size, tree, steps, events) in enumerate(fits):
            work.setdefault(repeat, []).append((k, size, tree, steps, events))
        for repeat, codes, y, ends in read(batches, list(work)):
            for k, size, tree, steps, events in work[repeat]:
                used = ends[size]
                known = np.arange(used) >= ends[0]
                counts[k] += np.bincount(4 * known + 2 * events[walk(tree, steps, codes[:used])] + y[:used], minlength=8)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    return run


def leaf_events(fit: Fit) -> np.ndarray:
    """1 for every node whose leaf predicts an event by the one-half rule, after sibling leaves of one class are joined as Spark joins them."""
    weight = lambda node, c: node.counts[c] * fit.weights[c]
    events = np.zeros(len(fit.nodes), np.int64)
    joined: dict[int, int] = {}
    for k in range(len(fit.nodes) - 1, -1, -1):  # children come after their parents
        node = fit.nodes[k]
        if node.feature < 0:
            joined[k] = int(weight(node, 1) > weight(node, 0) * (1 + SAME))
        elif joined.get(node.low, -1) == joined.get(node.high, -2):
            joined[k] = joined[node.low]
            node.feature = -1
        events[k] = weight(node, 1) >= weight(node, 0) * (1 - SAME)
    return events


def tree_confusions(
    rows: DataFrame, features: str, label: str, fits: Sequence[Fit], slots: int, max_depth: int, least: int, max_bins: int, seed: int = 42,
) -> list[dict[bool, tuple[int, int, int, int]]]:
    """Per fit the ``(tn, fp, fn, tp)`` of the rows its tree learned from (True) and of those held out (False).

    ``rows`` have the feature vector, a 0/1 label and ``parts`` (``shuffle_parts``). Each fit is the tree that Spark's
    ``DecisionTreeClassifier`` grows: candidate cuts by fit, Gini gain by weight, at least ``least`` rows a leaf. Values become the numbers
    of the cuts of all fits below them once, on disk; then a scan a level sums rows per (node, feature, bin, class) of all fits, whose sums are what
    a task keeps: memory depends on fits and cuts, not on rows. ``Fit.seconds`` is the tasks' time spent on the fit's sums.
    """
    spark, total = rows.sparkSession, max(sum(f.counts) for f in fits)
    plain = rows.select(vector_to_array(features).alias("values"), F.col(label).alias("y"), "parts")
    share = [(f.repeat, f.size, min(1.0, max(max_bins ** 2, CUT_ROWS) / sum(f.counts))) for f in fits]
    found = plain.mapInArrow(chosen_rows(share, slots, seed), "fit int, y binary, rows binary").groupBy("fit").applyInArrow(
        cuts_of([f.weights for f in fits], [min(max_bins, sum(f.counts)) for f in fits], slots), "fit int, cuts array<array<double>>")
    cuts = {r["fit"]: [np.array(c) for c in r["cuts"]] for r in found.collect()}  # a few numbers per fit and feature
    every = [np.unique(np.concatenate([cuts[k][f] for k in cuts])) for f in range(slots)]
    widths = np.array([max(len(cuts[k][f]) for k in cuts) + 1 for f in range(slots)])
    offsets, width = np.r_[0, np.cumsum(2 * widths)][:-1], 2 * int(widths.sum())
    starts = np.r_[0, np.cumsum([len(e) + 1 for e in every])][:-1].astype(np.int32)
    kind = "int16" if max(map(len, every)) < 1 << 15 else "int32"
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    codes = plain.mapInArrow(coded(every, kind), "codes binary, y tinyint, parts binary, spread int")
    if total > FOLD_ROWS:  # tasks of one size, however the rows lay in their files
        codes = codes.repartition(tasks, "spread")
    codes = codes.drop("spread")
    codes = codes.persist(StorageLevel.DISK_ONLY)
    read = repeats_of(starts, kind)

    def arrays(fit: Fit) -> list[np.ndarray]:
        return [np.array([getattr(n, name) for n in fit.nodes]) for name in ("feature", "cut", "low", "high")]

    try:
        for fit in fits:
            fit.nodes = [Node(fit.counts)]
        frontier, depth = [(k, 0) for k in range(len(fits))], 0
        while frontier and depth < max_depth:
            opened, together = [], max(1, MOST_CELLS // width)
            for at in range(0, len(frontier), together):
                some: dict[int, list[int]] = {}
                for k, node in frontier[at:at + together]:
                    some.setdefault(k, []).append(node)
                asked = [(k, fits[k].repeat, fits[k].size, cuts[k], arrays(fits[k]), depth, nodes) for k, nodes in some.items()]
                sums = codes.mapInArrow(summed(read, asked, every, starts, offsets, width), "fit int, cells binary, seconds double")
                best = sums.groupBy("fit").applyInArrow(
                    best_cuts({k: (nodes, fits[k].weights) for k, nodes in some.items()}, offsets, widths, width, least),
                    "fit int, node int, feature int, bin int, low0 long, low1 long, gain double, seconds double")
                for r in sorted(best.collect()):  # a row per frontier node
                    fit = fits[r["fit"]]
                    fit.seconds += r["seconds"]
                    if r["gain"] <= 0:
                        continue
                    node, low = fit.nodes[r["node"]], (r["low0"], r["low1"])
                    node.feature, node.cut = r["feature"], int(starts[r["feature"]] + np.searchsorted(every[r["feature"]], cuts[r["fit"]][r["feature"]][r["bin"]]))
                    for name, counts in (("low", low), ("high", (node.counts[0] - low[0], node.counts[1] - low[1]))):
                        setattr(node, name, len(fit.nodes))
                        fit.nodes.append(Node(counts))
                        if min(counts) > 0:
                            opened.append((r["fit"], len(fit.nodes) - 1))
            frontier, depth = sorted(opened), depth + 1
        events = [leaf_events(fit) for fit in fits]
        asked = [(fit.repeat, fit.size, arrays(fit), depth, seen) for fit, seen in zip(fits, events)]
        counted = codes.mapInArrow(judged(read, asked), "counts binary").collect()
    finally:
        codes.unpersist()
    counts = sum((np.frombuffer(r["counts"], np.int64).reshape(-1, 2, 2, 2) for r in counted), np.zeros((len(fits), 2, 2, 2), np.int64))
    return [{bool(known): (int(c[known, 0, 0]), int(c[known, 1, 0]), int(c[known, 0, 1]), int(c[known, 1, 1])) for known in (0, 1)} for c in counts]
