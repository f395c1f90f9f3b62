"""Language identification: a bidirectional gated recurrent network over bytes, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import clear_worker, in_fold, small_batches
from lendscope.llm.quality import bounded

HIDDEN, WINDOW = 8, 64
#: Windows run side by side.
SLAB = 4096
#: Training sample: documents of each language, of all languages together (with LEAST of each all the same), windows of a document.
SAMPLE, ALL, LEAST, WINDOWS = 300, 20_000, 20, 12
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode letter categories occurs: the rule that ``\\p{L}`` is for the rows to learn from."""
    return any(c.isalpha() for c in text)


def windows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes of the lower-cased texts, 0 past their end, and the text of each window."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    number = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    data = b"".join(r + bytes(-len(r) % WINDOW) for r in raw)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(raw)), number)


@dataclass
class Direction:
    """One gated recurrent layer: update, reset and candidate side by side, input weights held per byte."""

    table: np.ndarray  # (256, 3 * HIDDEN), biases inside
    state: np.ndarray  # (HIDDEN, 3 * HIDDEN)
    inner: np.ndarray  # (HIDDEN,) bias of the candidate's recurrent part

    def run(self, steps: np.ndarray):
        """States (time, batch, HIDDEN) over byte steps (time, batch), and what the gradient needs."""
        n = HIDDEN
        h = np.zeros((steps.shape[1], n), np.float32)
        states = np.empty((*steps.shape, n), np.float32)
        held = []
        for t, step in enumerate(steps):
            x, u = self.table[step], h @ self.state
            gate = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * n] + u[:, : 2 * n]))
            z, r = gate[:, :n], gate[:, n:]
            inner = u[:, 2 * n:] + self.inner
            c = np.tanh(x[:, 2 * n:] + r * inner)
            held.append((h, z, r, c, inner))
            h = c + z * (h - c)
            states[t] = h
        return states, held

    def apply(self, steps: np.ndarray) -> np.ndarray:
        """The same states as (time, HIDDEN, batch), in place and with units first, which numpy does fastest."""
        n, wide = HIDDEN, steps.shape[1]
        half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)
        table, state = np.ascontiguousarray(self.table.T * half[:, None]), np.ascontiguousarray(self.state.T * half[:, None])
        inner = self.inner[:, None]
        h, states = np.zeros((n, wide), np.float32), np.empty((len(steps), n, wide), np.float32)
        x, u, move = np.empty((3 * n, wide), np.float32), np.empty((3 * n, wide), np.float32), np.empty((n, wide), np.float32)
        gate, z, r, c, v = x[: 2 * n], x[:n], x[n: 2 * n], x[2 * n:], u[2 * n:]
        for t, step in enumerate(steps):
            np.take(table, step, axis=1, out=x, mode="clip")
            np.matmul(state, h, out=u)
            gate += u[: 2 * n]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            v += inner
            v *= r
            c += v
            np.tanh(c, out=c)
            np.subtract(h, c, out=move)
            move *= z
            h = np.add(c, move, out=states[t])
        return states

    def gradient(self, steps: np.ndarray, held: list, to_states: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time: gradients of table, state and inner."""
        n = HIDDEN
        state, inner_bias = np.zeros_like(self.state), np.zeros_like(self.inner)
        to_table = np.empty((*steps.shape, 3 * n), np.float32)
        to_h = np.zeros_like(to_states[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, c, inner = held[t]
            to_h = to_h + to_states[t]
            to_c = to_h * (1 - z) * (1 - c * c)
            to_z = to_h * (h - c) * z * (1 - z)
            to_r = to_c * inner * r * (1 - r)
            to_u = np.concatenate([to_z, to_r, to_c * r], axis=1)
            to_table[t] = np.concatenate([to_z, to_r, to_c], axis=1)
            state += h.T @ to_u
            inner_bias += (to_c * r).sum(axis=0)
            to_h = to_h * z + to_u @ self.state.T
        flat = to_table.reshape(-1, 3 * n)
        table = np.stack([np.bincount(steps.ravel(), flat[:, k], 256) for k in range(3 * n)], axis=1)
        return [table.astype(np.float32), state, inner_bias]


@dataclass
class LanguageNet:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (2 * HIDDEN, languages)
    bias: np.ndarray
    loss: list[float] = field(default_factory=list)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 3) -> LanguageNet:
        random = np.random.default_rng(seed)
        normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        layer = lambda: Direction(normal(256, 3 * HIDDEN, scale=0.4), normal(HIDDEN, 3 * HIDDEN, scale=0.35),
                                  np.zeros(HIDDEN, np.float32))
        return cls(languages, layer(), layer(), normal(2 * HIDDEN, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def windows_sum(self, steps: np.ndarray, real: np.ndarray) -> np.ndarray:
        """(batch, languages): probabilities of every position, summed over the real ones of each window."""
        ahead, behind = self.forward.apply(steps), self.backward.apply(steps[::-1])
        a, b, bias = (np.ascontiguousarray(w.T) for w in (self.out[:HIDDEN], self.out[HIDDEN:], self.bias[None]))
        total = np.zeros((len(self.languages), steps.shape[1]))
        for t in range(len(steps)):
            chance = a @ ahead[t]
            chance += b @ behind[len(steps) - 1 - t]
            chance += bias
            chance -= chance.max(axis=0)
            np.exp(chance, out=chance)
            chance *= real[t] / chance.sum(axis=0)
            total += chance
        return total.T

    def documents(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, languages): mean over all positions of the whole text; 0 for a text without bytes."""
        pooled = np.zeros((len(texts), len(self.languages)))
        size = np.zeros(len(texts))
        for part in bounded(texts, 1 << 20):
            cut, owner = windows(texts[part])
            owner = owner + part.start
            for at in range(0, len(cut), SLAB):
                steps = np.ascontiguousarray(cut[at: at + SLAB].T).astype(np.intp)
                real = (steps > 0).astype(np.float32)
                chance = self.windows_sum(steps, real)
                own = owner[at: at + SLAB]
                for language in range(len(self.languages)):
                    pooled[:, language] += np.bincount(own, chance[:, language], len(texts))
                size += np.bincount(own, real.sum(axis=0), len(texts))
        return pooled / np.maximum(size, 1)[:, None]

    def learn(self, cut: np.ndarray, label: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> LanguageNet:
        """Adam on the cross entropy of every position; each batch draws the languages evenly."""
        random = np.random.default_rng(seed)
        weights = [self.forward.table, self.forward.state, self.forward.inner,
                   self.backward.table, self.backward.state, self.backward.inner, self.out, self.bias]
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        by_language = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            some = np.concatenate([random.choice(own, max(1, batch // len(by_language))) for own in by_language])
            time = np.ascontiguousarray(cut[some].T)
            real = time > 0
            ahead, held_a = self.forward.run(time)
            behind, held_b = self.backward.run(time[::-1])
            both = np.concatenate([ahead, behind[::-1]], axis=2)
            chance = _softmax(both @ self.out + self.bias)
            target = np.eye(len(self.languages), dtype=np.float32)[label[some]]
            self.loss.append(float(-np.log(np.maximum((chance * target).sum(axis=2), 1e-9))[real].mean()))
            slope = (chance - target) * (real[..., None] / real.sum())
            to_both = slope @ self.out.T
            gradients = [*self.forward.gradient(time, held_a, np.ascontiguousarray(to_both[..., :HIDDEN])),
                         *self.backward.gradient(time[::-1], held_b, np.ascontiguousarray(to_both[::-1, :, HIDDEN:])),
                         np.einsum("tbh,tbl->hl", both, slope), slope.sum(axis=(0, 1))]
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(weights, gradients, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   sample: int = SAMPLE, per_doc: int = WINDOWS, steps: int = 320, batch: int = 160, rate: float = 0.02,
                   seed: int = 3) -> LanguageNet | None:
    """A network from up to ``sample`` documents of every language, ``per_doc`` windows spread evenly over each; None if
    nothing can be learned from. With many languages the documents of each are fewer, so that about ALL are read in all."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"), train.alias("train"))
    known = docs.filter(F.col("train") & F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = known.select("label").distinct().count()
    if not languages:
        return None
    each = min(sample, max(LEAST, ALL // languages))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = (known.select("id", "label").distinct()
              .withColumn("place", place).filter(F.col("place") <= each).drop("place"))  # at most max(ALL, LEAST * languages) rows
    chosen = F.broadcast(chosen) if LEAST * languages <= ALL else chosen
    bytes_ = F.lower("text").cast("binary")
    pieces = F.ceil(F.length(bytes_) / WINDOW)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_doc - 1)), lambda i: F.floor(i * pieces / per_doc)))
    rows = (known.join(chosen, ["id", "label"])
            .select("id", "label", F.transform(spread, lambda i: F.substring(bytes_, (i * WINDOW + 1).cast("int"), F.lit(WINDOW))).alias("cut"))
            .groupBy("label", "id").agg(F.min("cut").alias("cut")).orderBy("label", "id").toArrow())
    languages = sorted(set(rows.column("label").to_pylist()))
    if not languages:
        return None
    cut, label = [], []
    for name, parts in zip(rows.column("label").to_pylist(), rows.column("cut").to_pylist()):
        cut += [p.ljust(WINDOW, b"\0") for p in parts if p]
        label += [languages.index(name)] * sum(bool(p) for p in parts)
    data = np.frombuffer(b"".join(cut), np.uint8).reshape(-1, WINDOW)
    return LanguageNet.fresh(languages, seed).learn(data, np.array(label), steps, batch, rate, seed)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned only outside the held-out fold.

    ``score`` is the pooled probability of the predicted language. Null texts and texts without a letter are
    ``und`` with score 0, as is everything when there is nothing to learn from. A null id is not held out and not learned from; repeated
    rows give repeated rows; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = train_language(docs, ~in_fold(id_col, folds, held), id_col, text_col, lang_col, **options)

    def run(batches):
        import pyarrow as pa

        clear_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                some = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                if some:
                    pooled = model.documents([texts[i] for i in some])
                    for i, chance in zip(some, pooled):
                        names[i], scores[i] = model.languages[int(chance.argmax())], float(min(chance.max(), 1.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, folds, held).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
