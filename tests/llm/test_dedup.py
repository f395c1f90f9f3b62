"""Exact, near and line deduplication against brute force, with the awkward rows of every contract."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lendscope.llm import exact_dedup, line_dedup, near_dedup
from tests.llm.frames import collected, edge_rows, frame, prose

BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i or 0, n))
    found = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            keep = rows[best[3]][0]
            found.append((i, keep, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_edges(spark, bits):
    """With 3-bit hashes nearly all chunk identifiers clash and the texts decide."""
    rows = edge_rows() + [(20 + k, prose("en", 300, k % 3), "en", "a") for k in range(6)]
    df = exact_dedup.exact_dedup(frame(spark, rows), hash_bits=bits)
    assert collected(df, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(rows)
    assert df.filter("kept").count() == len({BLANK.sub("", t or "") for _, t, *_ in rows})


def test_exact_kept_rows_have_the_input_columns(spark):
    docs = frame(spark, edge_rows())
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len({BLANK.sub("", t or "") for _, t, *_ in edge_rows()})
    assert exact_dedup.kept_rows(docs.limit(0)).count() == 0


def test_chunks_cover_the_text(spark):
    text = prose("en", 500, 1).replace(" ", "") + "q" * 3000
    cut = frame(spark, [(1, text, None, None)]).select(exact_dedup.chunks(exact_dedup.F.col("text"))).first()[0]
    assert "".join(cut) == text and max(map(len, cut)) <= exact_dedup.MAX_CHUNK and len(cut) > 5


def words_of(text):
    return re.findall(r"[0-9a-z_]+", re.sub(r"[^\x00-\x7f]", "a_", (text or "").lower()))


def jaccard(a, b):
    bags = []
    for t in (a, b):
        w = [m.group() for m in re.finditer(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())]
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    whole = sum((bags[0] | bags[1]).values())
    return sum((bags[0] & bags[1]).values()) / whole if whole else 0.0


def brute_near(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                parent[root(a)] = root(b)
    classes = defaultdict(list)
    for n in range(len(rows)):
        classes[root(n)].append(n)
    found = []
    for members in classes.values():
        names = [rows[n][0] for n in members if rows[n][0] is not None]
        found += [(rows[n][0], min(names) if names else None) for n in members]
    return sorted(found, key=repr)


def edited(text, edits, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_near_classes_match_brute_force(spark):
    rows = edge_rows()
    for group in range(4):
        base = prose("en", 150, f"g{group}")
        rows += [(100 + group * 20 + k, edited(base, (0, 1, 2, 3)[k % 4], (group, k).__repr__()), "en", "a") for k in range(9)]
    rows += [(300 + k, prose("fr", 80, k), "fr", "b") for k in range(8)]
    df = near_dedup.near_classes(frame(spark, rows))
    assert collected(df, "doc_id", "class_id") == brute_near(rows)
    named = [(i, c) for i, c in brute_near(rows)]
    assert df.filter("kept").count() == len(near_dedup.kept_rows(frame(spark, rows)).collect())
    assert df.count() == len(named)


def test_chain_of_links_is_one_class(spark):
    """Each text is like the next, the ends are unlike: members of a bucket are not all like its leader."""
    words, rows = prose("en", 200, "chain").split(), []
    for step in range(10):
        rows.append((step, " ".join(words), "en", "a"))
        words[step * 18: step * 18 + 3] = [f"x{step}{k}" for k in range(3)]
    assert jaccard(rows[0][1], rows[-1][1]) < 0.8
    assert {c for _, c in collected(near_dedup.near_classes(frame(spark, rows)), "doc_id", "class_id")} == {0}


def test_texts_with_only_a_passage_in_common_are_not_paired(spark):
    """A hundred texts around one passage: rare cells pair none of them, but the two that are copies."""
    passage = prose("en", 50, "shared")
    rows = [(k, f"{prose('de', 30, k)} {passage} {prose('de', 30, -k)}", "en", "a") for k in range(1, 100)]
    rows += [(500, rows[7][1] + " one more word", "en", "a")]
    cells = [near_dedup._cells(*near_dedup.shingles(*near_dedup.word_hashes([t]))).view(np.int64).tolist() for _, t, *_ in rows]
    nodes = spark.createDataFrame([(i, i, c) for (i, *_), c in zip(rows, cells)], "node long, component long, cells array<long>")
    assert [tuple(r) for r in near_dedup.prefix_pairs(nodes, 0.8).collect()] == [(8, 500)]
    assert collected(near_dedup.near_classes(frame(spark, rows)), "doc_id", "class_id") == brute_near(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_rare_cells_lose_no_pair(spark, threshold):
    r = random.Random(int(threshold * 10))
    sets = []
    for k in range(90):
        base = set(range(100)) if k % 3 else {100 * k + j for j in range(r.randrange(1, 40))}
        sets.append(sorted(base - set(r.sample(range(100), r.randrange(0, 40))) | {10**6 + r.randrange(10**5) for _ in range(r.randrange(0, 30))}) or [k])
    component = [r.randrange(40) for _ in sets]
    nodes = spark.createDataFrame([(k, c, s) for k, (c, s) in enumerate(zip(component, sets))], "node long, component long, cells array<long>")
    found = {tuple(p) for p in near_dedup.prefix_pairs(nodes, threshold).collect()}
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= threshold
    every = {(a, b) for b in range(len(sets)) for a in range(b) if component[a] != component[b]}
    assert {p for p in every if alike(*p)} <= found <= every and len(found) < len(every)


@pytest.mark.parametrize("leaders", [0, 2])
def test_members_unlike_every_leader_still_meet(spark, leaders):
    rows = []
    for group in range(3):
        base = prose("en", 120, f"h{group}")
        rows += [(group * 100 + k, edited(base, 2 + k % 4, f"{group}-{k}"), "en", "a") for k in range(25)]
    assert collected(near_dedup.near_classes(frame(spark, rows), leaders=leaders), "doc_id", "class_id") == brute_near(rows)


def test_near_classes_of_an_empty_table(spark):
    assert near_dedup.near_classes(frame(spark, edge_rows()).limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 150), (300, 300)]
    random.Random(4).shuffle(edges)
    found = dict(collected(near_dedup.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert all(found[n] == 0 for n in range(61)) and {found[n] for n in (100, 150, 200)} == {100}


def test_dart_agreement_estimates_weighted_similarity():
    errors = []
    for seed in range(40):
        a = prose("en", 200 + 10 * seed, f"w{seed}")
        b = edited(a, 1 + seed % 9, str(seed))
        value, owner = near_dedup.shingles(*near_dedup.word_hashes([a, b]))
        prints = near_dedup.dart_signatures(value, owner, 2, 240)
        assert near_dedup.similarity(a, b) == pytest.approx(jaccard(a, b))
        errors.append((prints[0] == prints[1]).mean() - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def brute_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is None, i or 0)
    owner = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, rank(i)), rank(i))
    found = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if len(key(line)) < 10 or owner[key(line)] == rank(i)]
        found.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_matches_brute_force(spark, batches, fanout):
    r = random.Random(batches)
    pool = [prose("en", 4, k) for k in range(12)] + ["short", "  The Shared  LINE \x1f ", "the shared  line \x1f", "éééééééééé", "ééééééééé", ""]
    rows = edge_rows() + [(r.randrange(50), "\n".join(r.choice(pool) for _ in range(r.randrange(6))), None, None) for _ in range(60)]
    df = line_dedup.line_dedup(frame(spark, rows), batches=batches, fanout=fanout)
    assert collected(df, "doc_id", "n_lines", "n_dropped", "kept_text") == brute_lines(rows)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.line_dedup(frame(spark, edge_rows()).limit(0)).count() == 0


def test_runs_are_merged_by_level(spark):
    runs = line_dedup.LevelledRuns(2)
    for n in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), n) for k in range(n, n + 4)], "hash binary, owner int"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = {r.hash: r.owner for run in runs.runs() for r in run.collect()}
    assert {bytes(k): o for k, o in held.items()} == {bytes([k]): max(0, k - 3) for k in range(8)}
