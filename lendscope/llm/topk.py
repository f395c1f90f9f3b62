"""Exact top-k by inner product, block at a time with pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lendscope.llm.common import clear_worker, saved

#: Vectors of one document-range block, blocks of one lane, and queries of one batch.
BLOCK, LANE, BATCH = 1024, 32, 1024
#: Integer sums below this are exact in double arithmetic, so the fast product may be used.
EXACT = float(1 << 53)
#: The largest score.
TOP = (1 << 63) - 1


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v): components as floor(scale * x), every usable row under a number of its own.

    Left out: a null id, a null vector, and a vector that holds a null or a number that is not finite. Rows with one id
    stay apart. A component whose scaled value leaves 64 bits ends the job with an error rather than being cut.
    The numbers hold for one write of the rows, so callers save them before use.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    wide = F.raise_error(F.lit("a component times the scale leaves 64 bits")).cast("long")
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < float(1 << 63), F.floor(c * scale).cast("long")).otherwise(wide))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & usable)
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v")))


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Ranges of ids packed as (no, dims, n, ids, rows, data): the forward index of a block is one matrix.

    Each task packs its own sorted range, so a block never holds more than ``size`` vectors.
    """
    def pack(batches):
        import pyarrow as pa

        def block(ids, rows, matrix):
            wide = np.int64
            if matrix.size:
                low, high = matrix.min(), matrix.max()
                wide = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            return {"dims": matrix.shape[1], "n": len(ids), "bytes_each": np.dtype(wide).itemsize,
                    "ids": ids.astype(np.int64).tobytes(), "rows": rows.astype(np.int64).tobytes(), "data": matrix.astype(wide).tobytes()}

        names = pa.schema([("dims", pa.int64()), ("n", pa.int64()), ("bytes_each", pa.int64()),
                           ("ids", pa.binary()), ("rows", pa.binary()), ("data", pa.binary())])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            out = block(*(np.concatenate(part) for part in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_pylist([out], names)

        for batch in batches:
            dims = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            own = batch.column(2).to_numpy()
            flat = batch.column(3).flatten().to_numpy()
            ends = np.cumsum(dims)
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                wide = int(dims[begin])
                matrix = flat[ends[begin] - wide: ends[end - 1]].reshape(end - begin, wide)
                if held and held[0][2].shape[1] != wide:
                    yield flush()
                at = begin
                while at < end:
                    room = size - sum(len(i) for i, _, _ in held)
                    stop = min(end, at + room)
                    held.append((ids[at:stop], own[at:stop], matrix[at - begin: stop - begin]))
                    at = stop
                    if sum(len(i) for i, _, _ in held) == size:
                        yield flush()
        if held:
            yield flush()

    sized = rows.select(F.size("v").cast("long").alias("dims"), "vec_id", "row", "v")
    # The row number splits an id that many rows share.
    ranged = sized.repartitionByRange("dims", "vec_id", "row").sortWithinPartitions("dims", "vec_id", "row")
    packed = ranged.mapInArrow(pack, "dims long, n long, bytes_each long, ids binary, rows binary, data binary")
    return saved(packed.select(F.monotonically_increasing_id().alias("no"), "*"), name)


def _matrix(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[int(row.bytes_each)]
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.rows, np.int64), np.frombuffer(row.data, kind).reshape(int(row.n), int(row.dims)).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, none of which is larger than ``largest``."""
    if largest < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if largest < TOP / 2 else a.astype(object) @ b.T.astype(object)


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    found = _products(a, b, largest)
    if found.dtype == object:
        if found.size and (found.max() > TOP or found.min() < -TOP - 1):
            raise OverflowError("a score leaves 64 bits; use a smaller scale")
        found = found.astype(np.int64)
    return found


def search_lane(queries: list, index: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of the blocks in ``index`` for every vector of the blocks in ``queries``: (query row, query, vec_id, score).

    A block's bound for a query sums, over the components, the larger of component times block maximum and
    component times block minimum. Each query takes blocks by falling bound and stops where the bound lies below its
    k-th score so far; queries whose next block is the same one are scored together.
    """
    found: list[tuple[np.ndarray, ...]] = []
    known = [_matrix(b) for b in index]
    high = [m.max(axis=0, initial=np.iinfo(np.int64).min) for _, _, m in known]
    low = [m.min(axis=0, initial=np.iinfo(np.int64).max) for _, _, m in known]
    for qids, qrows, q in map(_matrix, queries):
        usable = [b for b, (_, _, m) in enumerate(known) if m.shape[1] == q.shape[1] and len(m)]
        if not usable or not len(qids):
            continue
        largest = max(float(np.abs(known[b][2]).max(initial=0)) for b in usable) * float(np.abs(q).max(initial=0)) * q.shape[1]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = np.stack([_products(up, high[b][None], largest)[:, 0] + _products(down, low[b][None], largest)[:, 0] for b in usable], axis=1)
        if bound.dtype == object:  # No score lies beyond 64 bits, so a bound need not either.
            bound = np.clip(bound, -TOP, TOP).astype(np.int64)
        order = np.argsort(-bound, axis=1, kind="stable")
        best_score = np.full((len(qids), k), np.iinfo(np.int64).min)
        best_id = np.full((len(qids), k), np.iinfo(np.int64).max)
        filled = np.zeros(len(qids), np.int64)
        for turn in range(len(usable)):
            block = order[:, turn]
            # A block whose bound equals the k-th score may still hold a smaller id.
            active = (filled < k) | (np.take_along_axis(bound, block[:, None], 1)[:, 0] >= best_score[:, -1])
            if not active.any():
                break
            for b in np.unique(block[active]):
                some = np.flatnonzero(active & (block == b))
                ids, rows, matrix = known[usable[b]]
                score = _scores(q[some], matrix, largest)
                mine = rows[None, :] == qrows[some][:, None]
                every = np.concatenate([best_score[some], score], axis=1)
                names = np.concatenate([best_id[some], np.broadcast_to(ids, score.shape)], axis=1)
                real = np.concatenate([np.arange(k)[None, :] < filled[some][:, None], ~mine], axis=1)
                pick = np.lexsort((names, -every, ~real), axis=1)[:, :k] if every.shape[1] <= 4 * k else _best(every, names, real, k)
                best_score[some] = np.take_along_axis(every, pick, 1)
                best_id[some] = np.take_along_axis(names, pick, 1)
                filled[some] = np.take_along_axis(real, pick, 1).sum(axis=1)
        have = np.arange(k)[None, :] < filled[:, None]
        found.append((*(np.broadcast_to(c[:, None], have.shape)[have] for c in (qrows, qids)), best_id[have], best_score[have]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(part) for part in zip(*found))


def _best(score: np.ndarray, names: np.ndarray, real: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties to the smaller name; a row with fewer real ones ends in others."""
    picks = np.empty((len(score), k), np.int64)
    for i in range(len(score)):
        at = np.flatnonzero(real[i])
        if len(at) > k:
            kth = np.partition(score[i, at], len(at) - k)[len(at) - k]
            at = at[score[i, at] >= kth]
        at = at[np.lexsort((names[i, at], -score[i, at]))][:k]
        rest = np.flatnonzero(~real[i])[: k - len(at)] if len(at) < k else at[:0]
        picks[i, : len(at)] = at
        picks[i, len(at): len(at) + len(rest)] = rest
        picks[i, len(at) + len(rest):] = picks[i, 0] if not len(rest) else rest[0]
    return picks


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10,
    scale: int = 1024, block: int = BLOCK, lane: int = LANE, batch: int = BATCH,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the same length but the
    query's own; ties go to the smaller id, and a query with fewer candidates gets them all. Of rows with one id each is
    a candidate, also for the others, and each is a query with ranks of its own. See ``scaled`` for the vectors that take
    no part. Scores are 64-bit integers; one that is not ends the job with an error. Only the two named columns are
    read, so others may have any name. A vector is one row's array, so its length is bounded by a task's memory. An
    empty table gives an empty result.

    Ranges of ids are packed into blocks once. A lane of blocks meets a batch of queries in one group
    of bounded size, where blocks are visited by falling bound until it lies below the query's k-th score;
    the lanes' best are then merged. No group grows with the table.
    """
    rows = saved(scaled(vectors, id_col, vec_col, scale), "scaled")
    index = blocks(rows, block, "blocks")
    asked = blocks(rows.filter(F.col("vec_id") % every == 0), min(batch, 256), "query-blocks")
    index = index.withColumn("lane", _groups(index, lane))
    asked = asked.withColumn("batch", _groups(asked, max(1, batch // 256)))
    index, asked = saved(index, "lanes"), saved(asked, "batches")
    lanes, batches = (df.agg(F.coalesce(F.max(c) + 1, F.lit(0)).cast("int").alias("n")).first().n
                      for df, c in ((index, "lane"), (asked, "batch")))
    schema = "query_row long, query_id long, vec_id long, score long"
    if not lanes or not batches:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    left = index.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).groupBy("lane", "batch")
    right = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).groupBy("lane", "batch")

    def run(own, queries):
        import pandas as pd

        clear_worker()
        row, query, vec, score = search_lane(list(queries.itertuples()), list(own.sort_values("no").itertuples()), k)
        return pd.DataFrame({"query_row": row, "query_id": query, "vec_id": vec, "score": score})

    found = left.cogroup(right).applyInPandas(run, schema)
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _groups(packed: DataFrame, size: int):
    """Running group numbers for blocks, ``size`` to a group, from their number inside each partition.

    Block numbers hold the partition in their upper bits, so offsets come from one count per partition.
    """
    counts = packed.groupBy(F.shiftright("no", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    start, offsets = 0, {}
    for part, n in sorted((r.part, r.n) for r in counts):
        offsets[part], start = start, start + n
    if not offsets:
        return F.lit(0)
    known = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair])
    position = F.element_at(known, F.shiftright("no", 33)) + F.col("no").bitwiseAND((1 << 33) - 1)
    return F.floor(position / size).cast("int")
