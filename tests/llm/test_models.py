"""Trained models: gradients, held-out accuracy and awkward rows; piece codec beside the library; pipeline stages."""

import hashlib
import os
import random
import subprocess
import sys
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendscope.llm import language, mixing, pieces, quality
from lendscope.llm.common import in_fold
from lendscope.llm.queries import piece_model
from tests.llm.frames import collected, edge_rows, frame, prose
from tests.llm.test_dedup import brute_exact, brute_near


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def held(i, folds, fold):
    import zlib

    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def junk(k):
    return [" ".join(w + "!!" for w in prose("en", 40, k).upper().split()), " | ".join(prose("en", 40, k).split()),
            " ".join(w + " " + w + " " + w for w in prose("en", 30, k).split())][k % 3]


def labelled(spark, n=240):
    rows = [(k, junk(k) if k % 3 == 0 else prose(("en", "de", "fr")[k % 7 % 3], 30 + k % 50, k), "en", "a") for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(n)] + [(5, None, 1), (None, 1, 0), (10**6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    got = quality.score_documents(frame(spark, rows + edge_rows()), labels).collect()
    assert len(got) == len(rows) + len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id, 5, 0) for r in got)
    first = {r.doc_id: r for r in got[: len(rows)]}
    out = [(r.predicted, int(i % 3 != 0)) for i, r in first.items() if r.held_out and i is not None and i > 10]
    assert len(out) > 20 and np.mean([a == b for a, b in out]) > 0.9


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_documents(frame(spark, edge_rows()), none).collect()
    assert {r.score for r in got} == {0.5} and quality.score_documents(frame(spark, edge_rows()).limit(0), none).count() == 0


def test_pooling_covers_the_whole_text():
    """Pooled responses equal a plain loop over all chunks, also where texts and slabs meet."""
    net = quality.ConvNet.fresh(1)
    texts = ["", "ab", "x" * 16, prose("en", 60, 1), prose("de", 9000, 2), "é" * 21, prose("fr", 7000, 3) + "!"]
    best, _ = net.pooled(*quality.byte_symbols(texts))
    for row, text in zip(best, texts):
        symbols, chunks = quality.byte_symbols([text])
        values = net.symbol[symbols]
        want = np.max([values[c * 4: c * 4 + 16].reshape(-1) @ net.filters + net.shift for c in range(int(chunks[0]))], axis=0)
        np.testing.assert_allclose(row, np.maximum(want, 0), atol=1e-4)
    assert quality.byte_symbols(["x" * 17])[1][0] == 2  # the last byte is in a chunk


def test_scores_do_not_depend_on_the_neighbours():
    """A text is marked and scored alike alone and behind a text that ends as it begins."""
    texts = ["abcdefgh" * 9, "abcdefgh and more of it", "efghabcd", "", "x", "y" * 60, "the end of the end of the end", "of the end of the"]
    whole, _ = quality.byte_symbols(texts)
    assert np.array_equal(whole, np.concatenate([quality.byte_symbols([t])[0] for t in texts]))
    assert not np.array_equal(whole, np.where(whole > 256, whole - 256, whole))
    net = quality.ConvNet.fresh()
    assert np.allclose(net.scores(texts), np.concatenate([net.scores([t]) for t in texts]), atol=1e-6)


def test_every_language_is_learned_and_letters_decide(spark):
    """Seventy languages of a few documents each; digits and signs that only count as word characters are no letters."""
    names = [f"l{k:02d}" for k in range(70)]
    rows = [(k * 5 + j, f"{chr(0x3041 + k)}{chr(0x4E00 + k)} " * 60, names[k], "a") for k in range(70) for j in range(5)]
    rows += [(9000, "\u00b2 \u00bd \u2460 12_", "en", "a"), (9001, "\u00aa", "en", "a")]
    found = {r.doc_id: r for r in language.identify(frame(spark, rows), steps=40).collect()}
    net = language.train_language(frame(spark, rows), F.lit(True), steps=1)
    assert set(net.languages) == {*names, "en"} and found[9000].lang_pred == "und" and found[9001].lang_pred != "und"


def test_worker_functions_load_without_the_package():
    """What is sent to executors carries its code: it is read by a process that cannot import the library."""
    from pyspark import cloudpickle

    from lendscope.llm import line_dedup, near_dedup, runs, secret_scan, topk

    for fn in (quality.byte_symbols, language.windows, line_dedup.line_hashes, near_dedup.word_hashes, near_dedup.dart_signatures,
               runs.all_runs, topk.search_lane, secret_scan.features, pieces.MergeCodec):
        code = ("import sys, pickle; sys.path[:] = [p for p in sys.path if p not in ('', %r)]; "
                "f = pickle.loads(sys.stdin.buffer.read()); f.__name__" % ROOT)
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(fn), cwd="/", capture_output=True, env={
            k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert done.returncode == 0, (fn, done.stderr.decode()[-500:])


def test_recurrent_gradients_match_differences():
    random_ = np.random.default_rng(0)
    layer = language.LanguageNet.fresh(["a", "b"], 1).forward
    for name in ("table", "state", "inner"):
        setattr(layer, name, getattr(layer, name).astype(np.float64))
    steps = random_.integers(1, 5, (6, 3))
    goal = random_.standard_normal((6, 3, language.HIDDEN))
    loss = lambda: float((layer.run(steps)[0].astype(np.float64) * goal).sum())
    states, kept = layer.run(steps)
    gradients = layer.gradient(steps, kept, goal)
    for name, g in zip(("table", "state", "inner"), gradients):
        w = getattr(layer, name)
        for _ in range(6):
            at = tuple(random_.integers(0, 5 if name == "table" and d == 0 else s) for d, s in enumerate(w.shape))
            old = w[at]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-2)
    np.testing.assert_allclose(layer.apply(steps).transpose(0, 2, 1), states, atol=1e-5)


def test_language_on_held_out_rows(spark):
    rows = [(k, prose(("en", "de", "fr")[k % 3], 20 + k % 40, k), ("en", "de", "fr")[k % 3], "a") for k in range(150)]
    edges = [(1000 + n, *r[1:]) for n, r in enumerate(edge_rows())]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows + edges), steps=120).collect()}
    assert len(got) == len(rows) + len(edges) and all(0 <= r.score <= 1 and r.held_out == held(i, 4, 2) for i, r in got.items())
    out = [(r.lang_pred, rows[i][2]) for i, r in got.items() if r.held_out and i < 150]
    assert len(out) > 20 and np.mean([a == b for a, b in out]) > 0.95
    for i, t, *_ in edges:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and (got[i].lang_pred != "und" or got[i].score == 0)


def test_language_without_anything_to_learn(spark):
    got = language.identify(frame(spark, [(1, "some text", None, "a"), (None, "andere", "de", "a")])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.identify(frame(spark, edge_rows()).limit(0)).count() == 0


def test_fold_rule(spark):
    got = frame(spark, [(i, None, None, None) for i in (0, 1, 17, 123456, -4, None)]).select("doc_id", in_fold("doc_id", 5, 0).alias("h")).collect()
    assert [(r.doc_id, r.h) for r in got] == [(r.doc_id, held(r.doc_id, 5, 0)) for r in got]


@pytest.fixture(scope="module")
def codec():
    return pieces.MergeCodec(piece_model())


def test_codec_equals_the_library(codec):
    r = random.Random(0)
    parts = [*" ▁\n\tabcdeßéñ,.!漢字😀\x00\x01<>s/0123‍", "  ", "   ", " the", "<s>", "<unk>", "<0x41>", "�", "ation", "x" * 60]
    texts = ["", " ", "▁", "a ", " a", *("".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000))]
    for (joined, own, decoded), text in zip(codec.encode_batch(texts), texts):
        ids = codec.library.encode(text)
        assert joined == ",".join(map(str, ids)) and own == ids and decoded == codec.library.decode(ids), repr(text)


def test_decoding_starts_from_the_ids(codec, monkeypatch):
    """Wrong ids give their own text, and the comparison with the library notices a wrong surface."""
    ids = codec.encode("the water runs")
    assert codec.speak(ids[::-1]) == codec.library.decode(ids[::-1]) != "the water runs"
    wrong = list(codec.surfaces)
    wrong[ids[0]] = b" else"
    monkeypatch.setattr(codec, "surfaces", wrong)
    with pytest.raises(ValueError, match="surfaces give"):
        codec.encode_batch(["the water runs"])


def test_side_by_side_merging_equals_the_agenda(codec):
    words = sorted({w for k in range(30) for lang in ("en", "de", "fr") for w in prose(lang, 50, k).split()}) + ["", "a  b", "漢字😀"]
    assert codec.merge_many(words) == [codec.merge(w) for w in words]


def test_flat_merging_of_strange_and_missing_segments(codec):
    words = ["", "漢字😀", "x" * 60, "\x00", "a  b", "é̂", "the"]
    ids, length = codec.merge_flat(words)
    assert length.tolist() == [len(codec.merge(w)) for w in words]
    assert ids.tolist() == [i for w in words for i in codec.merge(w)]
    assert [len(x) for x in codec.merge_flat([])] == [0, 0]
    for texts in ([], [""], ["x" * 60], [" ", "", "x" * 70 + " "]):
        assert [ids for _, ids, _ in codec.encode_batch(texts)] == [codec.library.encode(t) for t in texts]


def test_a_wrong_segment_is_noticed(monkeypatch):
    own = pieces.MergeCodec(piece_model())
    monkeypatch.setattr(own, "merge", lambda segment: [own.ids["a"]])
    with pytest.raises(ValueError, match="agenda"):
        own.encode_batch(["the water " + "runs" * 20])


def test_a_batch_does_not_walk_over_remembered_segments(monkeypatch):
    """The time of a small batch is that of its own segments, however many others are remembered."""
    own = pieces.MergeCodec(piece_model())

    def seconds(word: str) -> float:
        began = time.process_time()
        for k in range(100):
            own.encode_batch([f"{word}{k}"])
        return time.process_time() - began

    seconds("warm")
    alone = seconds("few")
    own.solved.update(dict.fromkeys(map(str, range(400_000)), b""))
    assert seconds("many") < 2 * alone + 0.1


def test_remembered_segments_are_bounded(codec, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    for k in range(20):
        text = prose("en", 30, k)
        assert codec.encode(text) == codec.library.encode(text) and len(codec.solved) <= 80


def test_encoding_holds_a_part_of_a_batch(codec, monkeypatch):
    """However many rows a batch has, a worker holds the ids of one part of it and solves a bounded number of segments."""
    def peak(texts):
        tracemalloc.start()
        for _ in codec.encode_parts(texts):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    texts = [prose("en", 60, k % 20) for k in range(128)]
    peak(texts)
    assert peak(texts * 10) < 1.5 * peak(texts)

    asked, learned = [], []
    own = pieces.MergeCodec(piece_model())
    whole, solve = own.encode_batch, own.learn
    monkeypatch.setattr(pieces, "CHARS_AT_ONCE", 100)
    monkeypatch.setattr(pieces, "FRESH_AT_ONCE", 7)
    monkeypatch.setattr(own, "encode_batch", lambda some: asked.append(sum(map(len, some))) or whole(some))
    monkeypatch.setattr(own, "learn", lambda fresh: learned.append(len(fresh)) or solve(fresh))
    rows = [None, "", prose("de", 90, 3)] + [f"w{k} of {k * k}" for k in range(300)] + ["", None]
    parts = list(own.encode_parts(rows))
    assert [k for part, _ in parts for k in range(part.start, part.stop)] == list(range(len(rows)))
    assert [f[1] for _, found in parts for f in found] == [codec.library.encode(t or "") for t in rows]
    assert max(learned) <= 7 and sorted(asked)[-2] <= 100 and list(own.encode_parts([])) == []


def test_encoded_column_of_many_rows(spark, codec):
    rows = [(k, None if k % 97 == 0 else prose("en", k % 9, k), "en", "a") for k in range(700)]
    got = frame(spark, rows).coalesce(1).select("doc_id", pieces.encode_column(F.col("text"), piece_model()).alias("p")).collect()
    texts = {k: t or "" for k, t, *_ in rows}
    assert len(got) == len(rows)
    assert all((r.p.ids, r.p.decoded) == ((ids := codec.library.encode(texts[r.doc_id])), codec.library.decode(ids)) for r in got)


def test_piece_digests(spark, codec):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in edge_rows():
        ids = codec.library.encode(t or "")
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(codec.library.decode(ids))))
    df = pieces.piece_digests(frame(spark, edge_rows()), piece_model())
    assert collected(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert pieces.piece_digests(frame(spark, edge_rows()).limit(0), piece_model()).count() == 0


def test_pipeline_stages(spark, tmp_path, codec):
    """Every stage on its predecessor's rows, each beside a brute-force version."""
    rows, labels = labelled(spark, 90)
    rows = rows + [(500 + k, prose("en", 60, 1) + " " * k, "en", "b") for k in range(3)]
    rows += [(None if i is None else 1000 + i, *rest) for i, *rest in edge_rows()]
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixing", "sentencepiece"]
    step = lambda name, d: spark.createDataFrame(stages[name](spark, d, str(tmp_path)).collect(), d.schema)
    plain = lambda d: [(r.doc_id, r.text, r.lang, r.source) for r in d.collect()]

    kept = step("quality_classifier", docs)
    scores = quality.score_documents(docs, labels).collect()
    assert kept.count() == sum(r.predicted for r in scores) and kept.columns == docs.columns
    once = step("exact_dedup", kept)
    assert once.count() == len({x[3] for x in brute_exact(plain(kept))})
    single = step("near_dedup", once)
    wordless = [r for r in plain(once) if not any(c.isalnum() or ord(c) > 127 or c == "_" for c in r[1] or "")]
    named = brute_near([r for r in plain(once) if r not in wordless])
    assert single.count() == len({c for _, c in named}) + len(wordless)
    mixed = step("source_mixing", single)
    assert mixed.count() == sum(r.taken // r["size"] for r in mixing.mix(single).collect() if r["size"])
    coded = stages["sentencepiece"](spark, mixed, str(tmp_path)).collect()
    assert len(coded) == mixed.count()
    texts = {}
    for r in plain(mixed):
        texts.setdefault(r[0], set()).add(r[1])
    assert all(r.decoded in {t.replace("▁", " ") for t in texts[r.doc_id]} and r.ids == codec.library.encode(r.decoded) for r in coded if "▁" not in r.decoded)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(coded)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, edge_rows()).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labelled(spark)[1].limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
