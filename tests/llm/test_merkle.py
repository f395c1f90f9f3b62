"""The manifest against a tree built level by level in Python, with awkward rows and other arities."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lendscope.llm import merkle
from tests.llm.frames import SCHEMA, collected, edge_rows, frame, prose


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, arity):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + arity])) for i in range(0, len(below), arity)])
    return levels


def way(levels, at, arity):
    steps = []
    for nodes in levels[:-1]:
        first = at - at % arity
        steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + arity])))
        at //= arity
    return steps


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row (doc_id, text, lang, source, n_chars)."""
    def leaf(r, more=0):
        n = None if r[4] is None else r[4] + more
        return sha("".join(framed(x) for x in (r[0], r[3], r[2], n, r[1])))

    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, int(hit)), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in order}
    over = tree([trees[g][-1][0] for g in order], arity)
    found = []
    for place, g in enumerate(order):
        for at, (_, _, own, shown, i) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps, node = way(trees[g], at, arity) + way(over, place, arity), shown
            for left, right in steps:
                node = sha(left + node + right)
            found.append((i, own, trees[g][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), node))
    return sorted(found, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def rows_of(count, langs):
    return [(k, prose("en", 3, k), langs[k % len(langs)], None if k % 5 else "s", None if k % 11 == 0 else k) for k in range(count)]


def docs(spark, rows):
    """With columns named like the operator's own."""
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "block", "pos", "n", "node", "part", "steps", "root", "start"):
        extra = extra.withColumn(name, F.lit("clash"))
    return extra


@pytest.mark.parametrize("count, langs", [
    (1, ["en"]), (2, ["en"]), (3, [None, "en", "é"]), (64, ["en"]), (65, ["en"]), (300, ["en", "en", "en", "de", None]), (4100, ["en"] * 60 + ["fr"]),
])
def test_manifest_equals_the_tree_built_by_levels(spark, count, langs):
    rows = rows_of(count, langs)
    result = merkle.verified_manifest(docs(spark, rows).repartition(3))
    want = brute(rows)
    assert collected(result, *COLUMNS) == want
    assert collected(result, "doc_id", "verified") == sorted([(w[0], w[5] == w[3]) for w in want], key=repr)


@pytest.mark.parametrize("arity, levels", [(3, 1), (3, 2), (4, 1)])
def test_other_arities(spark, arity, levels):
    rows = rows_of(50, ["en", "de", "en", None])
    result = merkle.manifest(docs(spark, rows), arity=arity, levels=levels)
    result = result.withColumn("proof_sha256", merkle.proof_digest(F.col("steps"))).withColumn(
        "folded_root", merkle.refold(F.col("leaf"), F.col("steps")))
    assert collected(result, *COLUMNS[:5]) == [w[:5] for w in brute(rows, arity)]
    assert result.filter("folded_root <> root").count() == 0


def test_edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, many rows of one id, and no rows at all."""
    rows = [(i, t, lang, s, None) for i, t, lang, s in edge_rows()] + [(77, "same", "en", "a", 4)] * 90 + [(None, None, None, None, None)] * 3
    result = merkle.verified_manifest(spark.createDataFrame(
        [(i, t, lang, s, n, "r", 1, "x", 9, 7) for i, t, lang, s, n in rows], SCHEMA))
    assert collected(result, *COLUMNS) == brute(rows)
    assert merkle.verified_manifest(frame(spark, [])).count() == 0


def test_no_window_holds_a_whole_group(spark):
    """Leaves are windowed by block, never by language alone."""
    plan = merkle.verified_manifest(docs(spark, rows_of(300, ["en"])))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("block" in line or "part" in line for line in windows if "node" in line)
