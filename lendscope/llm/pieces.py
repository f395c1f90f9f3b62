"""SentencePiece encoding and decoding of merge-type vocabularies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import bounded, clear_worker, small_batches

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Distinct segments a worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Segments from this length on are merged one by one.
LONG = 48
#: Texts and characters (or one longer text) that are encoded at once, and new segments that are solved at once; with
#: the remembered segments they bound a worker's memory, however many rows an Arrow batch has.
TEXTS_AT_ONCE, CHARS_AT_ONCE, FRESH_AT_ONCE = 128, 500_000, 8192
NO_PAIR = 1 << 30


class MergeCodec:
    """Encoder and decoder for one model file.

    Symbols start as the characters of the text. An agenda holds every adjacent pair that forms a vocabulary
    piece, best score first and leftmost among equals; taking a pair joins it, enters the pairs with its new
    neighbours and leaves outdated entries to be skipped. Symbols outside the vocabulary become their bytes.

    Where no piece has a space mark after another character, no merge crosses the start of a word, so a text is
    cut there and each distinct segment is solved once per worker. Every segment solved is compared with
    the sentencepiece library, one call for all new segments of an Arrow batch.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces
                or not rules.add_dummy_prefix or not model.trainer_spec.byte_fallback or not kinds <= {1, 2, 3, 6}):
            raise ValueError(f"{model_file}: a merge-type model with identity normalization and byte fallback is needed")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = {score: n for n, score in enumerate(sorted({-p.score for p in model.pieces if p.type == NORMAL}))}
        self.ranks = {p.piece: order[-p.score] for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.surfaces = [self._surface(p, model.trainer_spec.unk_surface) for p in model.pieces]
        self.id_text = [str(i) for i in range(len(self.surfaces))]
        self.local = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.solved: dict[str, bytes] = {}  # ids of a segment, four bytes each
        self._tables()

    @staticmethod
    def _surface(piece, unknown: str) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        if piece.type == UNKNOWN:
            return unknown.encode()
        return piece.piece.replace(SPACE, " ").encode() if piece.type == NORMAL else b""

    def segments(self, text: str) -> list[str]:
        """The text cut before each run of space marks; each segment stands after one mark of its own."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " " and self.local:
            return text.split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        return [s[1:] for s in (re.findall(f"{SPACE}+[^{SPACE}]*", marked) if self.local else [marked])]

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment and the mark before it, by the agenda.

        An entry is rank and place in one number, so equal scores go from left to right. It holds while the pair at
        that place still has that rank.
        """
        ranks = self.ranks
        symbols = [SPACE, *segment.replace(" ", SPACE)]
        last = len(symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        current = [ranks.get(a + b, -1) for a, b in zip(symbols, symbols[1:])]
        current.append(-1)
        agenda = [rank << 32 | place for place, rank in enumerate(current) if rank >= 0]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            place, rank = entry & 0xFFFFFFFF, entry >> 32
            if current[place] != rank:
                continue
            gone = after[place]
            symbols[place] = joined = symbols[place] + symbols[gone]
            symbols[gone], current[gone] = "", -1
            after[place] = following = after[gone]
            current[place] = -1
            if following < last:
                before[following] = place
                rank = ranks.get(joined + symbols[following], -1)
                if rank >= 0:
                    current[place] = rank
                    heappush(agenda, rank << 32 | place)
            earlier = before[place]
            if earlier >= 0:
                current[earlier] = rank = ranks.get(symbols[earlier] + joined, -1)
                if rank >= 0:
                    heappush(agenda, rank << 32 | earlier)
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                ids += [known] if known is not None else [self.bytes[b] for b in symbol.encode()]
        return ids

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """``merge`` for many short segments side by side."""
        ids, length = self.merge_flat(segments)
        ids, ends = ids.tolist(), np.cumsum(length).tolist()
        return [ids[begin:end] for begin, end in zip([0, *ends], ends)]

    def merge_flat(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and how many each has: each round takes the best entry of every
        segment's agenda."""
        marked = [SPACE + s.replace(" ", SPACE) for s in segments]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        symbol = self.point_symbol[np.minimum(points, len(self.point_symbol) - 1)]
        symbol = np.where(symbol >= 0, symbol, -2 - points)  # never part of a pair
        entry, joined = np.full(len(symbol), NO_PAIR), np.zeros(len(symbol), np.int64)
        entry[:-1], joined[:-1] = self._pairs(symbol[:-1], symbol[1:])
        entry[np.cumsum(length) - 1] = NO_PAIR
        left, owner = length, np.arange(len(marked))  # of the segments with open entries
        done_symbol, done_owner = [], []
        while len(symbol):
            end = np.cumsum(left)
            best = np.minimum.reduceat(entry << 32 | np.arange(len(entry)), end - left)
            open_ = best >> 32 < NO_PAIR
            stay = np.repeat(open_, left)
            if not open_.all():
                done_symbol.append(symbol[~stay])
                done_owner.append(np.repeat(owner[~open_], left[~open_]))
            place = best[open_] & 0xFFFFFFFF
            symbol[place] = joined[place]
            stay[place + 1] = False
            kept = np.flatnonzero(stay)
            symbol, entry, joined = symbol[kept], entry[kept], joined[kept]
            begin = (end - left)[open_]
            left, owner = left[open_] - 1, owner[open_]
            after = np.cumsum(left)
            at = place - begin + after - left
            for one, inside in ((at - 1, at > after - left), (at, at + 1 < after)):
                entry[at[~inside & (one == at)]] = NO_PAIR
                one = one[inside]
                entry[one], joined[one] = self._pairs(symbol[one], symbol[one + 1])
        if not done_symbol:
            return np.zeros(0, np.int64), length
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        symbol = symbol[np.argsort(owner, kind="stable")]
        known = symbol >= 0
        strange, place = np.unique(-2 - symbol[~known], return_inverse=True)
        spelled = np.concatenate([self.symbol_ids, self._padded([[self.bytes[b] for b in chr(p).encode()] for p in strange.tolist()])])
        symbol[~known] = len(self.symbol_ids) + place
        ids = spelled[symbol]
        used = ids >= 0
        each = used.sum(axis=1)
        ends = np.cumsum(np.bincount(owner, minlength=len(marked)))
        total = np.r_[0, np.cumsum(each)][ends]
        return ids[used], np.diff(total, prepend=0)

    @staticmethod
    def _padded(rows: list[list[int]]) -> np.ndarray:
        """Ids of symbols, a character's four bytes at most, -1 where there is none."""
        return np.array([r + [-1] * (4 - len(r)) for r in rows], np.int64).reshape(-1, 4)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair, NO_PAIR where it forms no piece."""
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_PAIR), self.pair_joined[at]

    def _tables(self) -> None:
        names = list(dict.fromkeys([*self.ids, *sorted({c for p in self.ids for c in p})]))
        number = {p: n for n, p in enumerate(names)}
        self.symbol_ids = self._padded([[self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()] for p in names])
        points = {ord(p): n for p, n in number.items() if len(p) == 1}
        self.point_symbol = np.full(max(points) + 2, -1, np.int64)
        self.point_symbol[list(points)] = list(points.values())
        pairs = sorted((number[p[:i]] << 20 | number[p[i:]], self.ranks[p], number[p])
                       for p in self.ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair_key, self.pair_rank, self.pair_joined = np.array(pairs, np.int64).T.copy()

    def learn(self, fresh: list[str]) -> None:
        """Solve segments and check them against the library; a difference ends the job with both results."""
        short = [s for s in fresh if len(s) < LONG]
        long = [s for s in fresh if len(s) >= LONG]
        ids, length = self.merge_flat(short)
        merged = [self.merge(s) for s in long]
        order = short + long
        flat = ids.tolist() + list(chain.from_iterable(merged))
        ends = list(accumulate(length.tolist() + [len(m) for m in merged]))
        others = self.library.encode(order, num_threads=1)
        if "" in order:  # the mark alone, which the library drops where nothing else is in a text
            at = order.index("")
            others[at] = flat[ends[at - 1] if at else 0:ends[at]]
        if ends != list(accumulate(map(len, others))) or flat != list(chain.from_iterable(others)):
            for segment, begin, end, other in zip(order, [0, *ends], ends, others):
                if flat[begin:end] != other:
                    raise ValueError(f"segment {segment!r}: agenda {flat[begin:end]}, library {other}")
        packed = np.array(flat, np.int32).tobytes()
        self.solved.update(zip(order, [packed[4 * begin:4 * end] for begin, end in zip([0, *ends], ends)]))

    def encode_batch(self, texts: list[str]) -> list[tuple[str, list[int], str]]:
        """(ids joined by commas, ids, text decoded from them) of each text.

        Whole texts are decoded from all their ids, by the pieces' surfaces, and compared with the library; a difference
        ends the job with both results.
        """
        cut = [self.segments(t) for t in texts]
        words = list(chain.from_iterable(cut))
        packed = list(map(self.solved.get, words))
        missing = [at for at, ids in enumerate(packed) if ids is None]
        if missing:
            fresh = list({words[at] for at in missing})
            if len(self.solved) + len(fresh) > REMEMBERED:
                self.solved.clear()
            for at in range(0, len(fresh), FRESH_AT_ONCE):
                self.learn(fresh[at:at + FRESH_AT_ONCE])
            for at in missing:
                packed[at] = self.solved[words[at]]
        ends = accumulate(map(len, cut), initial=0)
        ids = [np.frombuffer(b"".join(packed[begin:end]), np.int32).tolist() for begin, end in pairwise(ends)]
        joined = [",".join(map(self.id_text.__getitem__, own)) for own in ids]
        spoken = [self.speak(own) for own in ids]
        for text, own, other in zip(texts, spoken, self.library.decode(ids, num_threads=1) if ids else []):
            if own != other:
                raise ValueError(f"ids of {text[:200]!r}: surfaces give {own[:200]!r}, library {other[:200]!r}")
        return list(zip(joined, ids, spoken))

    def encode_parts(self, texts: Sequence[str | None], rows: int = TEXTS_AT_ONCE) -> Iterator[tuple[slice, list[tuple[str, list[int], str]]]]:
        """``encode_batch`` for consecutive parts of at most ``rows`` texts, null counting as empty."""
        for at in range(0, len(texts), rows):
            some = [t or "" for t in texts[at:at + rows]]
            for part in bounded(some, CHARS_AT_ONCE):
                yield slice(at + part.start, at + part.stop), self.encode_batch(some[part])

    def speak(self, ids: list[int]) -> str:
        """The text of ids: bytes side by side form characters, and the first mark is left out."""
        return b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text or ""])[0][1]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: byte ids side by side form characters, and the first mark is left out."""
        return self.library.decode(ids)


def encode_column(text: Column, model_file: str) -> Column:
    """Struct (ids array<int>, decoded string) of each text; null counts as empty."""
    codec: list[MergeCodec] = []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not codec:
            clear_worker()
            codec.append(MergeCodec(model_file))
        for texts in batches:
            for _, found in codec[0].encode_parts(texts.tolist()):
                yield pd.DataFrame({"ids": [f[1] for f in found], "decoded": [f[2] for f in found]})

    return F.pandas_udf(run, "ids array<int>, decoded string")(text)


def piece_digests(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", rows_per_call: int = 256,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no ids and decode to an empty text. Other columns are not read, repeated rows give repeated rows,
    an empty table an empty result. ``model_file`` must be readable on every executor.
    """
    def run(batches):
        import pyarrow as pa

        clear_worker()
        codec = MergeCodec(model_file)
        for whole in batches:
            for part, found in codec.encode_parts(whole.column(1).to_pylist(), rows_per_call):
                yield pa.RecordBatch.from_arrays([
                    whole.column(0).slice(part.start, part.stop - part.start),
                    pa.array([len(ids) for _, ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(joined.encode()).hexdigest() for joined, _, _ in found]),
                    pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, _, decoded in found]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
