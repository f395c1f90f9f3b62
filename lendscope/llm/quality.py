"""Quality classifier: a byte-level convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import bounded, in_fold, small_batches, thinned

#: Bytes of one chunk, distance between chunk starts, numbers per symbol, filters.
WIDTH, STRIDE, CHANNELS, FILTERS = 16, 4, 8, 24
#: A byte is marked as repeating when it ends RUN bytes that stood up to FAR bytes earlier as well.
RUN, NEAR, FAR = 6, 2, 40
SYMBOLS = 513  # 0 pads; 1 + byte; 257 + byte where repeating
#: Windows convolved at once.
SLAB = 8192
#: Labelled rows of each class used for training, and the longest text among them; scoring has no bound.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
#: Small samples are gone through more often, up to this many steps.
LEAST_STEPS = 300


def byte_symbols(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded to whole chunks, and the number of chunk starts of each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw])
    chunks = np.maximum(0, -(-(size - WIDTH) // STRIDE)) + 1
    room = (chunks - 1) * STRIDE + WIDTH
    data = np.frombuffer(b"".join(r + bytes(int(n) - len(r)) for r, n in zip(raw, room)), np.uint8)
    real = np.zeros(len(data), bool)
    place = np.cumsum(room) - room
    for begin, n in zip(place, size):
        real[begin: begin + n] = True
    symbols = data.astype(np.int16) + 1 + 256 * _repeating(data, place, room).astype(np.int16)
    symbols[~real] = 0
    return symbols, chunks


def _repeating(data: np.ndarray, place: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Marks of all texts, each text's from its own bytes alone; ``place`` and ``room`` say where they lie in ``data``."""
    found = np.zeros(len(data), bool)
    for lag in range(NEAR, FAR + 1):
        if len(data) < lag + RUN:
            break
        found[lag + RUN - 1:] |= _six(data[lag:] == data[:-lag])
    # Only the first bytes of a text can have met those of the text before: they are marked again, by rows.
    head = np.arange(FAR + RUN - 1)
    own = head[None, :] < room[:, None]
    at = np.minimum(place[:, None] + head[None, :], len(data) - 1)
    first = data[at]
    marks = np.zeros(first.shape, bool)
    for lag in range(NEAR, FAR):
        marks[:, lag + RUN - 1:] |= _six((first[:, lag:] == first[:, :-lag]).T).T
    found[at[own]] = marks[own]
    return found


def _six(one: np.ndarray) -> np.ndarray:
    """Where RUN true values in a row end, along the first axis."""
    two = one[1:] & one[:-1]
    four = two[2:] & two[:-2]
    return four[2:] & two[:-4]


@dataclass
class ConvNet:
    """Score = sigmoid(out . max over chunks of relu(chunk . filters + shift) + bias)."""

    symbol: np.ndarray  # (SYMBOLS, CHANNELS)
    filters: np.ndarray  # (WIDTH * CHANNELS, FILTERS)
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> ConvNet:
        random = np.random.default_rng(seed)
        normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        net = cls(normal(SYMBOLS, CHANNELS, scale=0.5), normal(WIDTH * CHANNELS, FILTERS, scale=0.12),
                  np.zeros(FILTERS, np.float32), normal(FILTERS, scale=0.2), np.zeros(1, np.float32))
        net.symbol[0] = 0
        return net

    def pooled(self, symbols: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, filters): the largest response over all chunks of the document, and the chunk it is from."""
        room = (chunks - 1) * STRIDE + WIDTH
        start = (np.cumsum(room) - room) // STRIDE
        owner_at = np.zeros(len(symbols) // STRIDE, np.int64)  # chunk starts stand STRIDE apart over all texts
        owner_at[start[1:]] += 1
        owner_at = np.cumsum(owner_at)
        last = (start + chunks)[owner_at]
        real = np.arange(len(owner_at)) < last
        best = np.zeros((len(chunks), FILTERS), np.float32)
        where = np.repeat(start[:, None], FILTERS, axis=1)
        total = len(owner_at) - (WIDTH // STRIDE - 1)
        for begin in range(0, total, SLAB):
            end = min(begin + SLAB, total)
            values = self.symbol[symbols[begin * STRIDE: (end - 1) * STRIDE + WIDTH]]
            step = values.strides[0]
            windows = np.lib.stride_tricks.as_strided(values, (end - begin, WIDTH * CHANNELS), (step * STRIDE, values.strides[1]))
            response = np.ascontiguousarray(windows) @ self.filters + self.shift
            response[~real[begin:end]] = -1
            own = owner_at[begin:end]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top = np.maximum.reduceat(response, cut)
            for i, (a, doc) in enumerate(zip(cut, own[cut])):
                better = top[i] > best[doc]
                if better.any():
                    stop = cut[i + 1] if i + 1 < len(cut) else end - begin
                    best[doc] = np.where(better, top[i], best[doc])
                    if self.track:
                        where[doc] = np.where(better, begin + a + response[a:stop].argmax(axis=0), where[doc])
        return best, where

    track = False

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        found = np.empty(len(texts))
        for part in bounded(texts, 1 << 20):
            best, _ = self.pooled(*byte_symbols(texts[part]))
            found[part] = 1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30)))
        return found

    def learn(self, texts: Sequence[str], labels: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> ConvNet:
        """Adam on the logistic loss; the gradient of a maximum goes to the chunk it came from."""
        random = np.random.default_rng(seed)
        labels = np.asarray(labels, np.float64)
        balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        names = ("symbol", "filters", "shift", "out", "bias")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step, self.track = 0, True
        for epoch in range(epochs):
            order = random.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at: at + batch]
                symbols, chunks = byte_symbols([texts[i] for i in some])
                best, where = self.pooled(symbols, chunks)
                p = 1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30)))
                slope = ((p - labels[some]) * balance[some] / len(some)).astype(np.float32)
                back = slope[:, None] * self.out * (best > 0)
                places = where[..., None] * STRIDE + np.arange(WIDTH)
                seen = symbols[places]  # (documents, filters, width)
                inputs = self.symbol[seen].reshape(len(some), FILTERS, WIDTH * CHANNELS)
                to_input = (back[..., None] * self.filters.T[None]).reshape(-1, CHANNELS)
                to_symbol = np.stack([np.bincount(seen.ravel(), to_input[:, c], SYMBOLS) for c in range(CHANNELS)], axis=1)
                to_symbol[0] = 0
                gradient = {"symbol": to_symbol, "filters": np.einsum("df,dfi->if", back, inputs), "shift": back.sum(axis=0),
                            "out": slope @ best, "bias": np.array([slope.sum()])}
                step += 1
                pace = rate * min(1.0, 2 * (1 - epoch / epochs))
                for n in names:
                    g = gradient[n].astype(np.float32)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    move = pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))
        self.track = False
        return self


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column,
                  sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Up to ``sample`` labelled texts of each class, in the order of a hash of the id."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train).groupBy(id_col)
             .agg(F.min(label_col).alias("label")))
    order = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    parts = [thinned(known.filter(F.col("label") == c), id_col, sample).orderBy(order, id_col).limit(sample) for c in (0, 1)]
    chosen = parts[0].union(parts[1])  # a fixed number of rows, so the broadcast is bounded
    rows = (docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
            .filter(F.length("text") <= chars).groupBy(id_col, "label").agg(F.min("text").alias("text"))
            .orderBy(F.xxhash64(id_col), id_col).select("text", "label").toArrow())
    return rows.column("text").to_pylist(), rows.column("label").to_numpy()


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = SAMPLE, epochs: int = 6, batch: int = 32,
                  rate: float = 0.01, seed: int = 7) -> ConvNet | float:
    """A network from the labelled texts of rows where ``train`` holds; without both classes the share of label 1."""
    texts, known = training_rows(docs, labels, id_col, text_col, label_col, train, sample)
    if len(set(known.tolist())) < 2:
        return float(known.mean()) if len(known) else 0.5
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
    return ConvNet.fresh(seed).learn(texts, known, epochs, batch, rate, seed)


def quality_score(text: Column, model: ConvNet | float) -> Column:
    """Probability of label 1 for each whole text; null counts as empty, and an empty text is one padded chunk."""
    def run(texts: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series([model] * len(texts), dtype="float64")
        return pd.Series(model.scores([t or "" for t in texts]))

    return F.pandas_udf(run, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 5, held: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; only rows outside the held-out fold are learned from.

    Repeated ids are scored row by row; an id with several labels counts with the smallest. A null id is not held
    out, a null label is no label, further columns are not read, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = train_quality(docs, labels, ~in_fold(id_col, folds, held), id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, folds, held).alias("held_out"),
                       quality_score(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
              held: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    small_batches(docs.sparkSession)
    model = train_quality(docs, labels, ~in_fold(id_col, folds, held), id_col, text_col, **options)
    return docs.filter(quality_score(F.col(text_col), model) >= threshold)
