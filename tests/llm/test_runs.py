"""Periodic runs against definitions: smallest periods, extensions and covers by brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendscope.llm import runs
from lendscope.llm.common import table
from tests.llm.frames import collected, edge_rows, frame, prose


def brute_runs(words, least=24, repeats=3):
    """Every maximal stretch of equal words at each distance; a stretch keeps its smallest distance."""
    n, found = len(words), {}
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, repeats * p):
                found.setdefault((s, i + p - s), p)
    return sorted([(s, m, p) for (s, m), p in found.items()], key=lambda x: (x[0], x[2]))


def brute_planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = brute_planted(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    found = brute_runs(words)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in found)]
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
           for x in ("".join(f"{s},{m},{p}\n" for s, m, p in found), " ".join(kept))]
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *sha)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def repetitive(seed, size, letters, block):
    r = random.Random(seed)
    words = []
    while len(words) < size:
        piece = [r.randrange(letters) for _ in range(r.randrange(1, block))]
        words += piece * r.choice([1, 1, 2, 3, 5, 30 // len(piece) + 1])
    return np.array(words[:size], np.int64)


def test_cover_reaches_every_distance():
    assert {(b - a) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))


@pytest.mark.parametrize("seed", range(12))
def test_extensions_equal_a_direct_count(seed):
    words = repetitive(seed, [40, 700, 3000][seed % 3], [2, 3, 50][seed // 4], 60)
    words = np.r_[words, words.max() + 1]
    look, r = runs.Extensions(words), np.random.default_rng(seed)
    i = r.integers(0, len(words), 400)
    j = np.where(r.random(400) < 0.5, r.integers(0, len(words), 400), np.minimum(i + r.integers(1, 9, 400), len(words) - 1))
    i, j = i[i != j], j[i != j]

    def direct(a, b):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        return k

    assert look(i, j).tolist() == [direct(a, b) for a, b in zip(i, j)]


@pytest.mark.parametrize("seed", range(10))
def test_runs_equal_brute_force(seed):
    texts = [repetitive(100 * seed + k, size, [1, 2, 3, 40][k % 4], 3 + 9 * k) for k, size in enumerate([0, 1, 23, 24, 25, 120, 400, 900])]
    assert runs.find_runs(texts) == [brute_runs(t.tolist()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.integers(2, 9), st.integers(2, 3))
def test_any_texts(texts, least, repeats):
    arrays = [np.array(t, np.int64) for t in texts]
    assert runs.find_runs(arrays, least, repeats) == [brute_runs(t, least, repeats) for t in texts]


def test_pieces_of_the_grid_do_not_change_the_result(monkeypatch):
    texts = [repetitive(k, 500, 2, 20) for k in range(3)]
    whole = runs.find_runs(texts)
    monkeypatch.setattr(runs, "PAIRS", 37)
    assert runs.find_runs(texts) == whole and any(whole)


def test_packs_hold_every_text_once():
    texts = [[b"w"] * n for n in (5, 0, 200, 3, 90, 1)]
    dealt = list(runs.packs(texts, 100))
    assert sorted(n for pack in dealt for n in pack) == list(range(6))
    assert all(len(pack) == 1 or sum(len(texts[n]) for n in pack) <= 100 for pack in dealt)


def test_edges(spark):
    """Nulls, empty texts, repeats, awkward white space, other scripts, and texts that are one single run."""
    rows = edge_rows() + [(100 + k, " ".join(str(w) for w in repetitive(k, 300, 3, 30)), "en", "a") for k in range(40)]
    rows += [(200, "漢 字 \x0b漢 字\n" * 50, "zh", "a"), (201, "word " * 3000, "en", "a"), (202, "a b " * 12, "en", "a"), (203, "a b " * 11, "en", "a")]
    result = runs.periodic_runs(frame(spark, rows), plant=True)
    assert collected(result, *COLUMNS) == sorted((brute_row(i, t) for i, t, *_ in rows), key=repr)
    one = {r.doc_id: r for r in result.collect()}[202]
    assert (one.starts, one.lengths, one.periods, one.collapsed) == ([0], [24], [2], "a b")
    assert runs.periodic_runs(frame(spark, []), plant=True).count() == 0


def test_a_very_long_text_is_searched_whole(spark):
    """200 000 words with periods near the end, on their own."""
    r = random.Random(5)
    body = [str(r.randrange(3000)) for _ in range(200_000)]
    body[199_000:199_900] = (body[:300] * 3)
    row = runs.periodic_runs(frame(spark, [(1, " ".join(body), "en", "a")])).first()
    assert (row.n_runs, row.period) == (1, 300) and row.starts[0] <= 199_000 and row.lengths[0] >= 900


def test_query_equals_brute_force(spark, sf_dir):
    from lendscope.llm.queries import QUERIES

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 6000]
    rows = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).select(*COLUMNS).collect()}
    assert len(rows) == len(docs) and [rows[r.doc_id] for r in short] == [brute_row(r.doc_id, r.text) for r in short]
