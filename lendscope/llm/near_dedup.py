"""Near-duplicate classes: DartMinHash signatures of word shingles, banded joining, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import clear_worker, saved, small_batches

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Further leaders that members of a divided bucket are compared with.
LEADERS = 1
#: Width of the first rank slab; each later slab doubles the ranks covered.
FIRST_SLAB, WIDEST_SLAB = 1 / 64, 64.0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
    text = np.arange(256)
    word = (text >= 0x80) | np.isin(text, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz_", np.uint8))
    return codes, word


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(length, _ODD)), np.cumprod(np.full(length, _INVERSE))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words of each text.

    A word is a run of letters, digits and underscores of the lower-cased text; any character beyond
    ASCII counts as a letter. Hashes come from one running polynomial over the bytes.
    """
    codes, in_word = _byte_tables()
    parts = [t.lower().encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    inside = in_word[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, back = _powers(len(data))
    with np.errstate(over="ignore"):
        running = np.concatenate([[np.uint64(0)], np.cumsum(codes[data] * powers)])
        words = mixed((running[stop] - running[start]) * back[start] + (stop - start).astype(np.uint64) * _ODD)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return words, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, its document's position), sorted by both. A text of fewer words has one shingle."""
    first = np.cumsum(counts) - counts
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    last = (first + counts)[owner]
    with np.errstate(over="ignore"):
        total = np.zeros(len(owner), np.uint64)
        for k in range(words):
            place = at + k
            have = place < last
            value = np.where(have, hashes[np.minimum(place, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(k + 1))
            total = mixed(total * _ODD + value.astype(np.uint64))
    order = np.lexsort((total, owner))
    return total[order], owner[order]


def occurrence(shingle: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """0 for the first of equal shingles of a document, 1 for the next, ..."""
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(shingle))
    return place - np.maximum.accumulate(np.where(new, place, 0))


def dart_signatures(shingle: np.ndarray, owner: np.ndarray, docs: int, size: int) -> np.ndarray:
    """DartMinHash: (docs, size) fingerprints whose agreement estimates weighted Jaccard similarity.

    A shingle that occurs w times is a region of weight w, made of w unit cells. Into each cell and slab of ranks,
    darts are thrown as a Poisson process seeded by the cell and the slab alone, so documents share the darts
    of shared cells. A dart has a rank, a coordinate and a fingerprint; each coordinate keeps its dart of lowest rank.
    Slabs are opened in rank order until every coordinate of a document is taken, so long documents, whose
    many cells fill all coordinates early, throw few darts per cell.
    """
    best = np.full((docs, size), np.inf)
    print_ = np.zeros((docs, size), np.uint64)
    with np.errstate(over="ignore"):
        cell = _cells(shingle, owner)
        low, width, slab = 0.0, FIRST_SLAB, 0
        while len(cell):
            seed = mixed(cell + np.uint64(2 * slab + 1) * _ODD)
            number = _poisson(unit(seed), width)
            hit = np.flatnonzero(number)
            dart = np.repeat(seed[hit], number[hit])
            turn = np.arange(len(dart)) - np.repeat(np.cumsum(number[hit]) - number[hit], number[hit])
            dart = mixed(dart ^ mixed((turn + 1).astype(np.uint64) * _ODD))
            doc = np.repeat(owner[hit], number[hit])
            coordinate = (mixed(dart + np.uint64(1)) % np.uint64(size)).astype(np.int64)
            rank = low + width * unit(mixed(dart + np.uint64(2)))
            slot = doc * size + coordinate
            order = np.lexsort((rank, slot))
            slot, rank, dart = slot[order], rank[order], dart[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            slot, rank, dart = slot[first], rank[first], dart[first]
            free = np.isinf(best.ravel()[slot])
            best.ravel()[slot[free]] = rank[free]
            print_.ravel()[slot[free]] = dart[free]
            unfinished = np.isinf(best).any(axis=1)[owner]
            cell, owner = cell[unfinished], owner[unfinished]
            low, width, slab = low + width, min(low + width, WIDEST_SLAB), slab + 1
    return print_


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers from uniform ones, by the inverse distribution function."""
    number = np.zeros(len(u), np.int64)
    term = np.exp(-mean)
    reached, k = term, 0
    rest = np.flatnonzero(u >= reached)
    while len(rest) and k < 10 * mean + 60:
        number[rest] += 1
        k += 1
        term *= mean / k
        reached += term
        rest = rest[u[rest] >= reached]
    return number


def band_keys(prints: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(bands, dtype=np.uint64) * _ODD, (len(prints), 1))
        for k in range(rows):
            key = mixed(key * _ODD + prints.reshape(len(prints), bands, rows)[:, :, k])
    return key.view(np.int64)


def similarity(left: str, right: str, words: int = WORDS) -> float:
    """Weighted Jaccard of the two texts' shingles: sum of smaller counts over sum of larger ones."""
    return _overlap(_cells(*shingles(*word_hashes([left]), words)), _cells(*shingles(*word_hashes([right]), words)))


def _cells(shingle: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One number for each unit of weight: the shingle and its occurrence."""
    with np.errstate(over="ignore"):
        return mixed(shingle + occurrence(shingle, owner).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - common
    return common / whole if whole else 0.0


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = WORDS, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    carry: Sequence[str] = (), batch_rows: int = 128, kept_only: bool = False, leaders: int = LEADERS,
) -> DataFrame:
    """One row per document (per kept one with ``kept_only``): doc_id, class_id, kept, n_shingles.

    Two texts are linked when the weighted Jaccard similarity of their ``words``-word shingles reaches
    ``threshold``; a class is a connected component, named by its smallest id, and that row has ``kept`` (one
    row only, if ids repeat). Texts without words, null ones among them, are linked to nothing and stand alone. A null
    id sorts last and names a class only if all its ids are null. An empty table gives an empty result. ``carry``
    columns come back in the struct ``row``.

    Texts of equal words are first joined to one representative. Representatives that agree in a band share a
    bucket. Not all pairs of a bucket are compared: each member is compared with two leaders, the bucket's first and
    last, and, while that still links something, with up to ``leaders`` more drawn ones. Pairs inside a component need no comparison, so
    a large group of copies costs links in proportion to its size. What shares a bucket and is still in different
    components meets once more over its rare cells (``prefix_pairs``), so no pair sharing a bucket stays undecided, and texts that have
    only a common passage in common are not compared at all. Comparison is exact, on whole texts.
    """
    small_batches(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(c) for c in carry]
    schema = "row_no long, digest binary, n_shingles long, bands array<long>"

    def sign(batches):
        import pyarrow as pa

        clear_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for part in _bounded(texts):
                    hashes, counts = word_hashes(texts[part])
                    value, owner = shingles(hashes, counts, words)
                    number = np.bincount(owner, minlength=part.stop - part.start)
                    keys = band_keys(dart_signatures(value, owner, len(number), bands * rows), bands, rows)
                    digests = [hashlib.blake2b(w.tobytes(), digest_size=16).digest()
                               for w in np.split(hashes, np.cumsum(counts)[:-1])]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(part.start, part.stop - part.start),
                        pa.array(digests, pa.binary()), pa.array(number, pa.int64()),
                        pa.array([list(k) if n else [] for k, n in zip(keys, number)], pa.list_(pa.int64())),
                    ], ["row_no", "digest", "n_shingles", "bands"])

    # The whole text is written once, inside the carried row where that holds it.
    inside = text_col in carry
    base = saved(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
        *([F.struct(*own).alias("row")] if own else []), *([] if inside else [F.col(text_col).alias("text")])), "near-rows")
    texts = base.select("row_no", (F.col(f"row.`{text_col}`") if inside else F.col("text")).alias("text"))
    signed = saved(texts.mapInArrow(sign, schema), "near-signatures")
    filled = signed.filter("n_shingles > 0")
    same = filled.groupBy("digest").agg(F.min("row_no").alias("rep"))
    members = filled.join(same, "digest").select("row_no", "rep")
    reps = filled.join(same, filled.row_no == same.rep, "left_semi")
    spread = reps.select(F.col("row_no").alias("node"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    sizes = spread.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = saved(spread.join(sizes, ["band", "key"]), "near-buckets")

    close = _Links(texts.withColumnRenamed("row_no", "node"), words, threshold)
    label = close.add(_leader_pairs(buckets, F.min).unionByName(_leader_pairs(buckets, F.max)).distinct(), None)
    for turn in range(leaders):
        pairs = _fresh(_turn_pairs(_split(buckets, label), turn), close.seen)
        found = close.add(pairs, label)
        label, linked = found, not close.seen[-1].filter("linked").isEmpty()
        if not linked:
            break
    label = close.add_cells(_split(buckets, label).select("node", "n_shingles", "component").distinct(), label)

    named = members.join(label, members.rep == label.node, "left").select(
        "row_no", F.coalesce("component", "rep").alias("component"))
    rows_named = base.select("row_no", "doc_id").join(signed.select("row_no", "n_shingles"), "row_no").join(named, "row_no", "left")
    rows_named = rows_named.withColumn("component", F.coalesce("component", "row_no"))
    best = rows_named.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_no")).alias("best"))
    result = rows_named.join(best, "component").select(
        "row_no", "doc_id", F.col("best.doc_id").alias("class_id"), (F.col("row_no") == F.col("best.row_no")).alias("kept"), "n_shingles")
    result = result.filter("kept") if kept_only else result
    return (result.join(base.select("row_no", "row"), "row_no") if own else result).drop("row_no")


def _bounded(texts: Sequence[str], most: int = 500_000) -> list[slice]:
    """Consecutive parts of at most ``most`` characters, or of one longer text."""
    parts, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            parts.append(slice(begin, i))
            begin, size = i, 0
        size += len(t)
    return parts + [slice(begin, len(texts))] if len(texts) > begin else parts


def _leader_pairs(buckets: DataFrame, pick) -> DataFrame:
    """Each other member of a bucket beside the bucket's first or last one."""
    leader = buckets.groupBy("band", "key").agg(pick(F.struct("node", "n_shingles")).alias("leader"))
    pairs = buckets.join(leader, ["band", "key"]).filter(F.col("leader.node") != F.col("node"))
    return _pairs(pairs.select(F.col("leader.node").alias("a"), F.col("leader.n_shingles").alias("na"),
                               F.col("node").alias("b"), F.col("n_shingles").alias("nb")))


def _split(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that span several components, with their component."""
    rows = _labelled(buckets, label)
    split = rows.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    return rows.join(split, ["band", "key"])


def _turn_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each member of a split bucket beside one more of its members, drawn by a hash, if that is of another component."""
    drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "n_shingles", "component")
    leader = rows.groupBy("band", "key").agg(F.min(drawn).alias("leader"))
    pairs = rows.join(leader, ["band", "key"]).filter(F.col("leader.component") != F.col("component"))
    return _pairs(pairs.select(F.col("leader.node").alias("a"), F.col("leader.n_shingles").alias("na"),
                               F.col("node").alias("b"), F.col("n_shingles").alias("nb")))


def _fresh(pairs: DataFrame, seen: Sequence[DataFrame]) -> DataFrame:
    for done in seen:
        pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    return pairs


def prefix_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all nodes (node, component, cells) of different components whose cells can reach the similarity.

    Cells are ordered by how few nodes hold them. Of n cells, two texts of that similarity share one among the rarest
    n - ceil(threshold * n) + 1 of each, so only these are joined; a passage that many texts share stands last and joins none of them.
    From the places of the first shared cell follows how many cells can be common at most, and sizes must be near enough. Nodes of
    a cell's lowest component are not paired with each other.
    """
    cells = nodes.select("node", F.explode("cells").alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("held"))
    ranked = cells.join(counts, "cell").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "cell"))).alias("order"))
    size = F.size("order")
    short = ranked.select("node", size.alias("n"), F.slice("order", F.lit(1), (size - F.ceil(threshold * size - 1e-9) + 1).cast("int")).alias("order"))
    places = short.join(nodes.select("node", "component"), "node").select(
        "node", "component", "n", F.posexplode("order").alias("pos", "x")).filter("x.held > 1").select(
        "node", "component", "n", "pos", F.col("x.cell").alias("cell"))
    places = saved(places, "near-prefixes")
    split = places.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    open_ = places.join(split, "cell")
    x, y = open_.alias("x"), open_.filter("component != low").alias("y")
    least = (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))  # this cell and all after it
    met = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.component") < F.col("y.component"))
                 & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold - 1e-9) & (most >= least))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _labelled(buckets: DataFrame, label: DataFrame) -> DataFrame:
    return buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                        F.least("na", "nb").alias("less"), F.greatest("na", "nb").alias("more")).distinct()


class _Links:
    """Verified links so far and the components they make."""

    def __init__(self, texts: DataFrame, words: int, threshold: float):
        self.texts, self.words, self.threshold = texts, words, threshold
        self.seen: list[DataFrame] = []

    def add(self, pairs: DataFrame, label: DataFrame | None) -> DataFrame:
        """Compare the pairs; the components of the old ones and the new links."""
        words, threshold = self.words, self.threshold

        def verify(batches):
            import pandas as pd

            clear_worker()
            for batch in batches:
                memo: dict[int, np.ndarray] = {}
                keep = []
                for a, left, right in zip(batch.a, batch.left, batch.right):
                    if a not in memo:
                        memo = {a: _cells(*shingles(*word_hashes([left]), words))}
                    keep.append(_overlap(memo[a], _cells(*shingles(*word_hashes([right]), words))) >= threshold)
                yield pd.DataFrame({"a": batch.a, "b": batch.b, "linked": keep})

        possible = pairs.filter(F.col("less") >= F.col("more") * threshold)
        left = self.texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
        right = self.texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
        sides = possible.select("a", "b").join(right, "b").join(left, "a")
        checked = saved(sides.select("a", "b", "left", "right").mapInPandas(verify, "a long, b long, linked boolean"), "near-pairs")
        self.seen.append(checked)
        return self._joined(checked.filter("linked").select("a", "b"), label)

    def add_cells(self, nodes: DataFrame, label: DataFrame) -> DataFrame:
        """Link what is left between components: shared rare cells bring pairs together, whole sets of cells decide."""
        words, threshold = self.words, self.threshold

        def cut(batches):
            import pyarrow as pa

            clear_worker()
            for whole in batches:
                for at in range(0, whole.num_rows, 128):
                    batch = whole.slice(at, 128)
                    sets = [_cells(*shingles(*word_hashes([t]), words)).view(np.int64) for t in batch.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))],
                                                     ["node", "component", "cells"])

        with_text = nodes.select("node", "component").join(self.texts, "node").select("node", "component", "text")
        held = saved(with_text.mapInArrow(cut, "node long, component long, cells array<long>"), "near-cells")
        pairs = _fresh(prefix_pairs(held, threshold), self.seen)
        side = lambda n: held.select(F.col("node").alias(n), F.col("cells").alias(f"cells_{n}"))
        common = F.size(F.array_intersect("cells_a", "cells_b"))
        whole = F.size("cells_a") + F.size("cells_b") - common
        linked = pairs.join(side("a"), "a").join(side("b"), "b").filter(common / whole >= threshold).select("a", "b")
        return self._joined(linked, label)

    def _joined(self, edges: DataFrame, label: DataFrame | None) -> DataFrame:
        if label is not None:
            edges = edges.union(label.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        return components(edges)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node of an edge.

    Each round points every node at the smallest node among its neighbours' roots and its own, then
    follows the pointers once; rounds end when no edge joins two roots. Every round is a written table.
    """
    edges = saved(edges.filter("a != b").distinct(), name)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    label = nodes.withColumn("component", F.col("node"))
    work = edges
    while True:
        # Hook: every root takes the smallest root that an edge leads to.
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")).filter("`to` < root")
        jump = saved(_shortened(hook), name)
        moved = label.join(jump, label.component == jump.root, "left")
        label = saved(moved.select("node", F.coalesce("to", "component").alias("component")), name)
        small, large = jump.select(F.col("root").alias("a"), F.col("to").alias("ra")), jump.select(F.col("root").alias("b"), F.col("to").alias("rb"))
        work = saved(work.join(small, "a", "left").join(large, "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a != b").distinct(), name)
        if work.isEmpty():
            return label


def _shortened(hook: DataFrame) -> DataFrame:
    """Pointers followed twice; chains that remain are shortened by later rounds."""
    for _ in range(2):
        step = hook.select(F.col("root").alias("mid"), F.col("to").alias("far"))
        hook = hook.join(step, hook["to"] == step["mid"], "left").select("root", F.coalesce("far", "to").alias("to"))
    return hook


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with the input's own columns."""
    return near_classes(docs, carry=docs.columns, kept_only=True, **options).select("row.*")
