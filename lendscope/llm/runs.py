"""Maximal periodic runs of words, by longest common extensions over difference-cover samples."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import clear_worker, small_batches

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 24, 3
#: Every distance modulo PERIOD is the difference of two members of COVER (fixed values; a test proves it).
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Words that are searched together, and pairs of positions that are compared at a time.
PACK_WORDS, PAIRS = 1 << 16, 1 << 20


class Extensions:
    """How far two suffixes of a word sequence agree.

    ``words`` holds numbers below 2 ** 31; its last one occurs nowhere else. Only suffixes that start at a position of the cover are
    sorted, first by PERIOD words, then by doubling. Two positions reach a pair of such suffixes after fewer than PERIOD
    words, which are compared directly; from there the answer is the least common prefix of neighbours between them
    in the sorted order, looked up in a sparse table.
    """

    def __init__(self, words: np.ndarray):
        size = len(words)
        top = int(words.max()) + 1
        self.words = np.concatenate([words, np.arange(top, top + 2 * PERIOD, dtype=np.int64)])
        #: Rank of a residue among those of the cover, and the member from which a distance leads to another member.
        self.slot = np.full(PERIOD, -1, np.int64)
        self.slot[list(COVER)] = np.arange(len(COVER))
        self.reach = np.zeros(PERIOD, np.int64)
        for a in COVER:
            for b in COVER:
                self.reach[(b - a) % PERIOD] = a
        starts = (np.arange(0, size, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
        self.starts = starts[starts < size]
        self.rank, levels = self._sorted()
        self.table = self._table(levels)

    def _sorted(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rank of every sampled suffix, and its class by the first PERIOD * 2 ** k words for each k that was needed."""
        rank = np.zeros(len(self.starts), np.int64)
        active = np.arange(len(rank))
        for at in range(0, PERIOD, 2):
            key = self.words[self.starts[active] + at]
            if at + 1 < PERIOD:
                key = key << 31 | self.words[self.starts[active] + at + 1]
            active = refine(rank, active, key)
        levels = []
        jump = len(COVER)
        while len(active):
            levels.append(rank.copy())
            ahead = active + jump
            key = np.where(ahead < len(rank), levels[-1][np.minimum(ahead, len(rank) - 1)], -1)
            active = refine(rank, active, key)
            jump *= 2
        return rank, levels

    def _table(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Sparse table of the common prefixes of neighbours in sorted order."""
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(order))
        first, second = order[:-1], order[1:]
        length = np.zeros(len(first), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            moved = length // PERIOD * len(COVER)
            a, b = first + moved, second + moved
            inside = np.maximum(a, b) < len(order)
            same = inside & (levels[k][np.minimum(a, len(order) - 1)] == levels[k][np.minimum(b, len(order) - 1)])
            length += np.where(same, PERIOD << k, 0)
        length += self._direct(self.starts[first] + length, self.starts[second] + length, np.full(len(first), PERIOD))
        table = [length]
        while 2 << len(table) - 1 <= len(length):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, at most ``most``."""
        length = np.zeros(len(i), np.int64)
        active = np.flatnonzero(most > 0)
        step = 0
        while len(active):
            active = active[self.words[i[active] + step] == self.words[j[active] + step]]
            step += 1
            length[active] = step
            active = active[most[active] > step]
        return length

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ahead = (self.reach[(j - i) % PERIOD] - i) % PERIOD
        length = self._direct(i, j, ahead)
        on = np.flatnonzero(length == ahead)
        if len(on):
            length[on] += self._least(self._place(i[on] + ahead[on]), self._place(j[on] + ahead[on]))
        return length

    def _place(self, position: np.ndarray) -> np.ndarray:
        return self.rank[position // PERIOD * len(COVER) + self.slot[position % PERIOD]]

    def _least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        width = high - low
        level = np.frexp(width.astype(np.float64))[1].astype(np.int64) - 1
        found = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return found


def refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by ``key`` (given for ``active``, all members of groups of several); a rank is the
    number of suffixes in groups before its own. Returns the members of the groups that are still of several."""
    if not len(active):
        return active
    order = np.lexsort((key, rank[active]))
    active, key = active[order], key[order]
    group = rank[active]
    old = np.r_[True, group[1:] != group[:-1]]
    new = old | np.r_[True, key[1:] != key[:-1]]
    places = np.arange(len(active))
    old_at = np.maximum.accumulate(np.where(old, places, 0))
    new_at = np.maximum.accumulate(np.where(new, places, 0))
    rank[active] = group + new_at - old_at
    alone = new & np.r_[new[1:], True]
    return active[~alone]


def grid(sizes: np.ndarray, least: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period) of the harmonic grid, in pieces: for each period a text can hold, positions so
    dense that one of them stands in the first half of any stretch that makes a run."""
    most = np.where(sizes >= least, sizes // repeats, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = grid_step(period, least, repeats)
    points = -(-(sizes[text] - period) // step)
    done = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        own = points[at:to]
        which = np.repeat(np.arange(at, to), own)
        place = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
        yield text[which], place * step[which], period[which]
        at = to


def stretch(period: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Positions in a row that equal the one a period later, in the shortest run of that period."""
    return np.maximum(least, repeats * period) - period


def grid_step(period: np.ndarray, least: int, repeats: int) -> np.ndarray:
    return (stretch(period, least, repeats) + 1) // 2


def find_runs(texts: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, a sequence of word numbers, by start, then period.

    A run is a stretch with smallest period q and at least max(``least``, ``repeats`` * q) words that no neighbouring word
    extends; ``repeats`` is 2 or more. All texts form one sequence with a mark of its own before, between and after them, so no extension leaves its text.
    """
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not (sizes >= least).any():
        return runs
    mark = max(int(t.max()) for t in texts if len(t)) + 1
    parts: list[np.ndarray] = [np.array([mark], np.int64)]
    for n, t in enumerate(texts):
        parts += [t, np.array([mark + 1 + n], np.int64)]
    words = np.concatenate(parts)
    first = np.cumsum(sizes + 1) - sizes  # place of each text's first word
    forward = backward = None
    found: dict[tuple[int, int, int], int] = {}
    for text, place, period in grid(sizes, least, repeats):
        i = first[text] + place
        on = np.flatnonzero(words[i] == words[i + period])
        if not len(on):
            continue
        text, i, period = text[on], i[on], period[on]
        forward = forward or Extensions(words)
        right = forward(i, i + period)
        need = stretch(period, least, repeats)
        on = np.flatnonzero(right > need - grid_step(period, least, repeats))
        if not len(on):
            continue
        text, i, period, right, need = text[on], i[on], period[on], right[on], need[on]
        backward = backward or Extensions(words[::-1])
        left = backward(len(words) - i, len(words) - i - period)
        on = np.flatnonzero(left + right >= need)
        start, length = (i - left - first[text])[on], (left + right + period)[on]
        text, period = text[on], period[on]
        order = np.lexsort((period, length, start, text))  # multiples of the smallest period give the same stretch
        spans = np.stack([text, start, length])[:, order]
        fresh = np.flatnonzero(np.r_[True, (spans[:, 1:] != spans[:, :-1]).any(0)]) if len(order) else order
        for *span, shortest in np.vstack([spans[:, fresh], period[order[fresh]]]).T.tolist():
            found[tuple(span)] = min(shortest, found.get(tuple(span), shortest))
    for (text_no, start, length), period in found.items():
        runs[text_no].append((start, length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers; equal words have one number within a call."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]


def packs(texts: list[list[bytes]], most: int = PACK_WORDS) -> Iterator[list[int]]:
    """Texts that are searched together: of like sizes, up to ``most`` words, or one longer text."""
    pack: list[int] = []
    total = 0
    for n in sorted(range(len(texts)), key=lambda n: len(texts[n])):
        if pack and total + len(texts[n]) > most:
            yield pack
            pack, total = [], 0
        pack.append(n)
        total += len(texts[n])
    if pack:
        yield pack


def all_runs(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for pack in packs(texts):
        for n, own in zip(pack, find_runs(numbered([texts[n] for n in pack]), least, repeats)):
            runs[n] = own
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text with each run reduced to its first period; words joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join(word for word, stays in zip(words, keep) if stays)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent length / period, then smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:  # runs come by start and period, so the first of equals stays
            best = run
    return best


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the contract's planted period: by crc32 of the decimal id every tenth text repeats from some word on.
    A null id leaves the text as it is."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: int = REPEATS,
    plant: bool = False, texts: bool = True,
) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, all runs, and the text with every run reduced to its first period.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``. A run is a stretch of words with smallest period q and
    max(``least``, ``repeats`` * q) words or more that no neighbouring word extends. Of equal exponents the smallest start, then
    period counts. ``plant`` first applies :func:`planted`; ``texts=False`` leaves the arrays of runs and the collapsed text null, so
    that only digests are returned.

    Null and empty texts have no words and no runs. Texts of any length are searched whole, a very long one on its own: time grows
    with n log n, memory with n. Repeated rows and rows without an id are rows like any other; an empty table gives an empty result; input
    columns of any other name are left out. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        clear_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bodies = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
                if plant:
                    bodies = [planted(w, i) for w, i in zip(bodies, batch.column(0).to_pylist())]
                columns: list[list] = [[] for _ in range(11)]
                for words, runs in zip(bodies, all_runs(bodies, least, repeats)):
                    best = best_run(runs)
                    short = collapsed(words, runs)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    row = [len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                           hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(short).hexdigest(),
                           *(([r[k] for r in runs] if texts else None) for k in range(3)), short.decode("utf-8", "surrogatepass") if texts else None]
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    ["doc_id", *[part.split()[0] for part in SCHEMA.split(", ")]])

    return base.mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")
