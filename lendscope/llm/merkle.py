"""Merkle manifest of a table: lag and lead windows per level supply siblings, first-child rows hash parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one parent, and levels that are folded inside one block between two shuffles.
ARITY, LEVELS = 2, 6


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*[framed(value) for value in fields.values()])


def positioned(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, the place from 0 of each row in its group by ``order`` (nulls first), and ``n``, the rows of the group.

    Rows are dealt into ranges of (group, order), numbered inside each range and shifted by the counts of the
    ranges before it, so a group of any size is spread over many tasks. Rows equal in ``order`` are split as well: a row number
    ends the range key.
    """
    numbered = rows.withColumn("spread", F.monotonically_increasing_id())
    ranged = saved(numbered.repartitionByRange(group, *order, "spread").withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("part", group).agg(F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "part", group, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    place = F.row_number().over(Window.partitionBy("part", group).orderBy(*order, "spread")) - 1
    placed = ranged.withColumn("place", place).join(starts, ["part", group])
    return placed.withColumn("pos", F.col("start") + F.col("place")).drop("part", "spread", "start", "place")


def folded(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Adds ``steps``, the siblings (left, right) of each node over the next ``levels`` levels, and ``top``, the digest of
    its ancestor there, on the rows that stand first in their block.

    ``nodes`` holds key, block, pos, n and node; a block is arity ** levels nodes. A node of level l lives on the row of its
    first descendant. Its siblings stand arity ** l rows apart, so lags and leads of fixed offsets reach them; the node's slot in its run
    says which of them belong to the run, a lead past the last run's end is null. A group of at most arity ** l nodes
    is done at level l and its digest only passes on.
    """
    window = Window.partitionBy("key", "block").orderBy("pos")
    rows = nodes.withColumn("n0", F.col("node"))
    for level in range(levels):
        width, here = arity ** level, f"n{level}"
        first = F.col("pos") % width == 0
        open_ = F.col("n") > width
        slot = F.floor(F.col("pos") / width) % arity
        rows = rows.select(
            "*", *[F.lag(here, k * width).over(window).alias(f"lag{k}") for k in range(1, arity)],
            *[F.lead(here, k * width).over(window).alias(f"lead{k}") for k in range(1, arity)])
        left = F.concat(F.lit(""), *[F.when(slot >= k, F.col(f"lag{k}")).otherwise("") for k in range(arity - 1, 0, -1)])
        right = F.concat(F.lit(""), *[F.when(slot + k < arity, F.coalesce(f"lead{k}", F.lit(""))).otherwise("") for k in range(1, arity)])
        rows = rows.withColumn(f"step{level}", F.when(first, F.when(open_, F.struct(left.alias("left"), right.alias("right")))
                                                      .otherwise(F.struct(F.lit(None).alias("left"), F.lit(None).alias("right")))))
        heads = F.when(F.col("pos") % (width * arity) == 0,
                       F.when(open_, digest(F.col(here), F.col(f"step{level}.right"))).otherwise(F.col(here)))
        rows = rows.withColumn(f"n{level + 1}", heads).drop(*[f"{side}{k}" for side in ("lag", "lead") for k in range(1, arity)])
    sofar = window.rowsBetween(Window.unboundedPreceding, 0)
    steps = [F.last(f"step{level}", ignorenulls=True).over(sofar).alias(f"step{level}") for level in range(levels)]
    rows = rows.select(*nodes.columns, F.col(f"n{levels}").alias("top"), *steps)
    kept = F.filter(F.array(*[f"step{level}" for level in range(levels)]), lambda s: s["left"].isNotNull())
    return rows.withColumn("steps", kept).drop(*[f"step{level}" for level in range(levels)])


def paths(nodes: DataFrame, most: int, beyond, arity: int, levels: int) -> DataFrame:
    """``nodes`` (key, pos, n, node, ...) with ``steps`` from each node to its group's root and on, and the columns
    that ``beyond`` adds.

    ``most`` is the largest n. Groups folded to one node are handed to ``beyond`` (key, node), which returns key, ``above`` (the
    steps from there on) and its further columns. Every join is on (key, block), one upper row for each block.
    """
    if most <= 1:
        ends = beyond(nodes.select("key", "node"))
        return nodes.join(ends, "key").withColumnRenamed("above", "steps")
    width = arity ** levels
    rows = folded(nodes.withColumn("block", F.floor(F.col("pos") / width)), arity, levels)
    tops = saved(rows.filter(F.col("pos") % width == 0).select(
        "key", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("node")), "merkle-nodes")
    upper = paths(tops, -(-most // width), beyond, arity, levels)
    upper = upper.drop("n", "node").withColumnsRenamed({"pos": "block", "steps": "above"})
    return rows.join(upper, ["key", "block"]).withColumn("steps", F.concat("steps", "above")).drop("block", "top", "above")


def refold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
    shown: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """doc_id, leaf, shown, steps, subroot, root: a tree over the rows of each group, and one over the groups' roots.

    A leaf hashes ``fields`` of its row, each ``-`` if null. Leaves ascend by id in their group; every ``arity`` nodes in a row
    become their hash, a last shorter run too, until one is left; a lone leaf is its group's root. Roots, by group value
    (null first, bytewise), are folded alike into ``root``. ``steps`` holds the siblings (left, right) of every level from the
    leaf to the root. ``shown`` gives other values of some fields, and the column of that name their leaf: what a
    later reading of the table would hash. :func:`refold` compares it.

    A null group is a group of its own, a null id comes first, empty text is a field of 0 bytes, very long texts are hashed whole.
    Rows of one id are ordered by leaf; equal rows are separate leaves. An empty table gives an empty result.
    Input columns of any other name are left out.

    The text is read once. Ranges give each leaf its place, whatever the sizes of the groups; blocks of ``arity ** levels``
    leaves are folded by windows, their tops likewise, so a table of n rows takes log(n) / ``levels`` rounds, each over a table smaller
    by that factor.
    """
    plain = {name: F.col(f"`{name}`") for name in fields}
    leaf = leaf_digest(plain)
    other = leaf_digest({**plain, **shown}) if shown else leaf
    leaves = saved(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("-")).alias("key"),
        leaf.alias("node"), other.alias("shown")), "merkle-leaves")
    leaves = positioned(leaves, "key", ["doc_id", "node"])
    most = leaves.agg(F.max("n")).first()[0] or 0

    def over_groups(roots: DataFrame) -> DataFrame:
        """Folds the groups' roots: their tree is one group, whose nodes are ordered by the group's value."""
        roots = roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "node")
        roots = saved(positioned(roots, "key", ["group"]), "merkle-roots")
        number = roots.count()
        end = lambda last: last.select("key", F.array().cast(STEPS).alias("above"), F.col("node").alias("root"))
        return paths(roots, number, end, arity, levels).select(
            F.col("group").alias("key"), F.col("steps").alias("above"), F.col("node").alias("subroot"), "root")

    return paths(leaves, most, over_groups, arity, levels).select("doc_id", F.col("node").alias("leaf"), "shown", "steps", "subroot", "root")


STEPS = "array<struct<left:string,right:string>>"


def proof_digest(steps: Column) -> Column:
    """Hash of the siblings of every level, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` checked against a reading whose ``n_chars`` is one more wherever 7 divides the unsigned crc32 of
    the decimal id: the tampered rows' folded roots differ from the root. Null counts stay, a null id is never tampered."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = manifest(docs, shown={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    rows = rows.withColumn("folded_root", refold(F.col("shown"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
