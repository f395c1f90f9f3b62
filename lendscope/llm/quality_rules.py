"""Quality rules: counts of each document, and the divergence of its histograms from its language, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import BLANK, full_text, saved
from lendscope.sources.workspace import settle

WORD = BLANK.replace("[", "[^") + "+"
#: Characters that count as symbols, and the base rule.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_SHARE = 50, 50
#: Character classes of the first histogram, vowels and consonants first; whatever is in none of them is the last one.
CLASSES = ("[aeiou]", "[b-df-hj-np-tv-z]", "[A-Z]", "[0-9]", BLANK, r"[.,;:!?'\"()-]", r"[^\x00-\x7F]")
#: The second histogram counts the COMMON most frequent words of the language that have up to SHORT letters, and all others.
COMMON, SHORT = 24, 5
#: Greatest Jensen-Shannon distances, and the sizes from which they are judged.
CLASS_LIMIT, CLASS_CHARS = 0.30, 200
WORD_LIMIT, WORD_WORDS = 0.28, 100
REFERENCE_WORDS = 1000


def class_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``classes``, the code points of ``text`` in each of CLASSES and in none, and ``n_symbols``.

    Classes are taken away one after the other, letters first, so each pass reads only what the ones before have left.
    """
    text, blank = F.col("text"), CLASSES.index(BLANK)
    rows = rows.withColumns({"_vowels": F.length(F.regexp_replace(text, CLASSES[0].replace("[", "[^") + "+", "")),
                             "_left": F.regexp_replace(text, CLASSES[0][:-1] + CLASSES[1][1:] + "+", "")})
    counts = {0: F.col("_vowels"), 1: F.length(text) - F.length("_left") - F.col("_vowels")}
    left = "_left"
    for k in (blank, *(k for k in range(len(CLASSES) - 1, 1, -1) if k != blank)):
        rows = rows.withColumn(f"_left{k}", F.regexp_replace(left, CLASSES[k] + "+", ""))
        counts[k] = F.length(left) - F.length(f"_left{k}")
        left = f"_left{k}"
    return rows.withColumns({
        "classes": F.array(*[counts[k].cast("long") for k in range(len(CLASSES))], F.length(left).cast("long")),
        "n_symbols": (F.length(left) - F.length(F.regexp_replace(left, f"[{SYMBOLS}]+", ""))).cast("long"),
    })


def short_words(text: Column, letters: int = SHORT) -> Column:
    """The words of at most ``letters`` code points, all of them letters, in lower case."""
    side = "(?{}" + BLANK.replace("[", "[^") + ")"
    pattern = side.format("<!") + r"\p{L}{1," + str(letters) + "}" + side.format("!")
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, common): the most frequent short words of each language over all documents, ties by the word."""
    words = docs.select("lang", F.explode(short_words(F.col("text"))).alias("word"))
    counts = words.groupBy("lang", "word").count()
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word")))
    return ranked.filter(F.col("place") <= most).groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("common"))


def repeated_words(windows: Column) -> Column:
    """Words that stand in a window found twice or more; ``windows`` is the sorted array of (window, place).

    Equal windows are neighbours there. The places of repeated windows, in order, each cover three words, less what the next
    one covers.
    """
    def found(w):
        same = lambda x, y: F.coalesce(F.get(w, y)["window"] == x["window"], F.lit(False))
        return F.sort_array(F.transform(F.filter(w, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["place"]))

    def covered(places):
        fresh = F.transform(places, lambda x, k: F.coalesce(F.least(F.get(places, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda total, x: total + x)

    return let(let(windows, found), covered)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and the two histograms ``classes`` and ``words`` of each document.

    ``docs`` holds doc_id, lang and text.
    """
    listed = settle(common_words(docs, common))
    rows = docs.join(listed.withColumnRenamed("lang", "known"), F.col("lang").eqNullSafe(F.col("known")), "left").select(
        "doc_id", "lang", "text", "common", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("split"),
        short_words(F.col("text")).alias("short"), F.split("text", "\n", -1).alias("split_lines"))
    after = lambda k: F.get("split", k)
    full = F.greatest(F.size("split") - 2, F.lit(0))
    codes = F.slice(F.transform("split", lambda w, k: F.xxhash64(w, after(k + 1), after(k + 2))), 1, full)
    # Windows whose codes all differ are all different; only other documents have theirs written out and sorted.
    rows = class_counts(rows).withColumn("codes", codes)
    windows = F.transform("split", lambda w, k: F.struct(F.concat_ws(" ", w, after(k + 1), after(k + 2)).alias("window"), k.alias("place")))
    windows = F.sort_array(F.slice(windows, 1, full))
    blank = F.get("classes", F.lit(CLASSES.index(BLANK)))
    rows = rows.select(
        "doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.size("split").cast("long").alias("n_words"),
        (F.length("text") - blank).cast("long").alias("word_chars"), "n_symbols", "classes",
        F.filter("split_lines", lambda line: line.rlike(WORD)).alias("lines"),
        F.when(F.size("codes") > F.size(F.array_distinct("codes")), windows).alias("windows"),
        F.array(*[(F.size("short") - F.size(F.array_remove("short", F.coalesce(F.get("common", F.lit(k)), F.lit("")))))
                  .cast("long") for k in range(common)]).alias("words"))
    return rows.select(
        "doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("windows").isNull(), F.lit(0).cast("long")).otherwise(repeated_words(F.col("windows"))).alias("n_repeat_words"), "classes",
        F.concat("words", F.array(F.col("n_words") - F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x))).alias("words"))


def base_rule() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def references(rows: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, ref_words, ref_classes, ref_common): the summed histograms of each language's documents that pass the base rule."""
    def summed(name, size):
        return F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(size)])

    return rows.filter(~F.col("base_failed")).groupBy("lang").agg(
        F.sum("n_words").alias("ref_words"), summed("classes", len(CLASSES) + 1).alias("ref_classes"),
        summed("words", common + 1).alias("ref_common"))


def shannon_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms given as arrays of counts; null if one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x)

    def term(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def both(sums):
        def one(x, y):
            a, b = F.try_divide(x, sums["p"]), F.try_divide(y, sums["q"])
            return (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2

        return F.aggregate(F.zip_with(p, q, one), F.lit(0.0), lambda s, x: s + x)

    found = let(F.struct(total(p).alias("p"), total(q).alias("q")), both)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(found, F.lit(0.0))))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = COMMON,
    class_limit: float = CLASS_LIMIT, class_chars: int = CLASS_CHARS, word_limit: float = WORD_LIMIT, word_words: int = WORD_WORDS,
    reference_words: int = REFERENCE_WORDS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A document of fewer than 50 words, or with more than half of its words in 3-word windows that occur twice, fails the base rule.
    All others are compared with the documents of their language that pass it: histograms of character classes (judged from
    ``class_chars`` code points) and of the language's most common short words (judged from ``word_words`` words) must stay
    within the limits of the Jensen-Shannon distance. A language with fewer than ``reference_words`` words in such documents
    judges none.

    Null and empty texts have no words and fail; a null language is a language of its own; texts are counted whole, a very long one within
    its row; repeated rows and null ids are rows like any other. An empty table gives an empty result. Input columns of
    any other name are left out. The text is read twice, once for the common words and once for all counts; only counts of distinct
    short words are shuffled.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), full_text(F.col(f"`{text_col}`")).alias("text"))
    rows = saved(counted(base, common).withColumn("base_failed", base_rule()), "rule-counts")
    known = settle(references(rows, common)).withColumnRenamed("lang", "known")
    rows = rows.join(known, F.col("lang").eqNullSafe(F.col("known")), "left").withColumns({
        "class_distance": shannon_distance(F.col("classes"), F.col("ref_classes")),
        "word_distance": shannon_distance(F.col("words"), F.col("ref_common")),
    })
    judged = F.col("ref_words") >= reference_words
    off = ((F.col("n_chars") >= class_chars) & (F.col("class_distance") > class_limit)
           | (F.col("n_words") >= word_words) & (F.col("word_distance") > word_limit))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(judged & off, F.lit(False))).alias("kept"), "class_distance", "word_distance")
