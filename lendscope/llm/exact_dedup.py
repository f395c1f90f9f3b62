"""Exact deduplication over content-defined chunk recipes, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import blank_free, full_text, saved

#: A chunk ends after one of these letter pairs once it has MIN_CHUNK code points, at MAX_CHUNK otherwise.
CUT_FIRST, CUT_SECOND = "[dglptuéöñDGLPTU0-3]", "[aehsnAEHSN4-7,!*]"
MIN_CHUNK, MAX_CHUNK = 64, 1024


def chunks(normal: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined cuts: an insertion moves only the cuts near it, and equal texts are cut alike."""
    pattern = f"(?s).{{{least},{most - 2}}}?{CUT_FIRST}{CUT_SECOND}|.{{1,{most}}}"
    return F.regexp_extract_all(normal, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    value = F.xxhash64(chunk)
    return value if bits == 64 else F.pmod(value, F.lit(1 << bits))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), hash_bits: int = 64,
) -> DataFrame:
    """One row per document with the document that stays for its text.

    Texts are equal when identical without white space; null is an empty text. The row with the most
    code points stays, then the smallest id (a null id last), then any one of fully equal rows, so
    exactly one row of a group has ``kept``. An empty table gives an empty result. ``carry`` names
    further input columns to return; they may have any name, also one of the result's own, as they
    come back inside the struct ``row``.

    Each text is cut into content-defined chunks. Distinct chunks travel once, combined in each task
    first: a chunk hash that stands for a single chunk text anywhere is a verified identifier, a hash
    shared by different texts is replaced by the text itself. Documents are then compared by their ordered
    identifiers, so a long document that has thousands of copies is never moved again. ``hash_bits``
    shortens the hashes in tests.
    """
    own = [F.col(f"`{c}`").alias(c) for c in carry]
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.length(full_text(text_col)).cast("long").alias("n_chars"),
        blank_free(full_text(text_col)).alias("normal"), *([F.struct(*own).alias("row")] if own else []),
    )
    cut = base.withColumn("chunks", chunks(F.col("normal")))
    pieces = cut.select(F.explode("chunks").alias("chunk")).select(
        chunk_hash(F.col("chunk"), hash_bits).alias("chunk_id"), "chunk").distinct()
    shared = saved(pieces.groupBy("chunk_id").count().filter("count > 1").select("chunk_id"), "shared-chunk-ids")

    recipes = cut.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "n_chars",
        F.sha2("normal", 256).alias("text_sha256"), *(["row"] if own else []),
        F.transform("chunks", lambda c: chunk_hash(c, hash_bits)).alias("ids"),
        *([] if shared.isEmpty() else ["chunks"]),
    )
    recipes = saved(_named_by_text(recipes, shared) if "chunks" in recipes.columns else recipes, "recipes")

    order = F.struct("n_chars", F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("low"),
                     (-F.col("row_no")).alias("first"))
    groups = recipes.groupBy("ids").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    joined = recipes.join(groups, "ids")
    return joined.select(
        "doc_id", (-F.col("best.low")).alias("keep_id"), "group_size",
        (F.col("row_no") == -F.col("best.first")).alias("kept"), "text_sha256", "n_chars", *(["row"] if own else []),
    )


def _named_by_text(recipes: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes whose identifiers with several chunk texts are replaced by the chunk text."""
    steps = recipes.select("row_no", F.posexplode(F.arrays_zip("ids", "chunks")).alias("pos", "piece"))
    clash = steps.select("row_no", "pos", F.col("piece.ids").alias("chunk_id"), F.col("piece.chunks").alias("chunk"))
    texts = clash.join(shared.withColumn("clash", F.lit(True)), "chunk_id", "left")
    ordered = texts.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.when(F.col("clash"), F.concat(F.lit("t"), "chunk")).otherwise(F.col("chunk_id").cast("string")).alias("id"),
    ))).alias("steps")).select("row_no", F.col("steps.id").alias("named"))
    return (recipes.join(ordered, "row_no", "left").withColumn("ids", F.coalesce("named", F.array().cast("array<string>")))
            .drop("named", "chunks"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    result = exact_dedup(docs, id_col, text_col, carry=docs.columns)
    return result.filter("kept").select("row.*")
