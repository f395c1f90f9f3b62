"""Counts, references and distances of the quality rules against plain Python, with awkward rows."""

import math
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lendscope.llm import quality_rules as rules
from tests.llm.frames import collected, edge_rows, frame, prose

WORD = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def kind(c):
    if c in "aeiou":
        return 0
    if c in string.ascii_lowercase:
        return 1
    if c in string.ascii_uppercase:
        return 2
    if c in string.digits:
        return 3
    if c in " \t\n\x0b\x0c\r":
        return 4
    if c in ".,;:!?'\"()-":
        return 5
    return 6 if ord(c) > 127 else 7


def distance(p, q):
    if not sum(p) or not sum(q):
        return None
    total = 0.0
    for a, b in zip(p, q):
        a, b = a / sum(p), b / sum(q)
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) for x in (a, b) if x) / 2
    return math.sqrt(max(total, 0.0))


def brute(rows, reference_words):
    docs = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(WORD, text)
        classes = [0] * 8
        for c in text:
            classes[kind(c)] += 1
        docs.append((i, text, lang, words, classes, [w.lower() for w in words if len(w.lower()) <= 5 and w.isalpha()]))
    counts = defaultdict(Counter)
    for d in docs:
        counts[d[2]].update(d[5])
    common = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:24]] for lang, c in counts.items()}
    found, refs = [], defaultdict(lambda: [0, [0] * 8, [0] * 25])
    for i, text, lang, words, classes, short in docs:
        cells = [short.count(w) for w in common.get(lang, [])]
        cells += [0] * (24 - len(cells))
        cells.append(len(words) - sum(cells))
        numbers = brute_counts(text)
        failed = numbers[0] < 50 or 100 * numbers[4] > 50 * numbers[0]
        if not failed:
            r = refs[lang]
            r[0] += len(words)
            r[1] = [a + b for a, b in zip(r[1], classes)]
            r[2] = [a + b for a, b in zip(r[2], cells)]
        found.append((i, text, lang, numbers, failed, classes, cells))
    result = []
    for i, text, lang, numbers, failed, classes, cells in found:
        ref = refs.get(lang, [0, [0] * 8, [0] * 25])
        by_class, by_word = distance(classes, ref[1]), distance(cells, ref[2])
        off = ref[0] >= reference_words and ((len(text) >= 200 and by_class > 0.3) or (numbers[0] >= 100 and by_word > 0.28))
        result.append((i, *numbers, failed, not failed and not off, by_class and round(by_class, 9), by_word and round(by_word, 9)))
    return sorted(result, key=repr)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def result_of(spark, rows, reference_words):
    found = rules.quality_rules(frame(spark, rows), reference_words=reference_words)
    return collected(found.withColumns({c: F.when(F.col(c) > 0, F.round(c, 9)).otherwise(F.col(c)) for c in ("class_distance", "word_distance")}),
                     *COLUMNS, "class_distance", "word_distance")


@pytest.mark.parametrize("least", [0, 1000])
def test_rules_equal_plain_python(spark, least):
    """The awkward rows, clean prose, and junk of several kinds among it."""
    rows = edge_rows() + [(100 + k, prose(lang, 60 + 7 * k, k), lang, "a") for k in range(30) for lang in ("en", "de")]
    rows += [(200, " | ".join(prose("en", 150, 1).split()), "en", "a"), (201, "BUY!! " * 10 + prose("en", 120, 2).upper(), "en", "a"),
             (202, " ".join(w + "***" for w in prose("de", 130, 3).split()), "de", "a"), (203, (prose("en", 30, 4) + "\n") * 6, "en", "a"),
             (204, "漢字 " * 20 + " ".join(f"語{k}" for k in range(90)), "zh", "a"), (205, prose("en", 90, 5) + "\n" + prose("fr", 90, 6), None, "a")]
    got, want = result_of(spark, rows, least), brute(rows, least)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    for g, w in zip(got, want):
        assert g[8:] == pytest.approx(w[8:], abs=1e-7) or g[8:] == w[8:]
    kept = {g[0]: g[7] for g in got}
    if least == 0:
        assert not any(kept[i] for i in (200, 201, 202, 203)) and sum(kept[100 + k] for k in range(30)) == 30


def test_repeated_windows_overlap(spark):
    texts = ["a b c a b c a b c", "a a a a a", "x y z q x y z", "a b", "", None, "a b c d e a b c", "p q r s t p q r s"]
    rows = [(k, t, "en", None) for k, t in enumerate(texts)]
    found = rules.quality_rules(frame(spark, rows))
    assert collected(found, "doc_id", "n_repeat_words") == [(k, brute_counts(t)[4]) for k, t in enumerate(texts)]


def test_no_rows(spark):
    assert rules.quality_rules(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = rules.quality_rules(frame(spark, edge_rows()))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow", plan)


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    """Of documents labelled good that pass the base rule nearly all stay; most labelled bad go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = rules.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, rows))
    assert share[1] > 0.98 and share.get(0, 0) < 0.3
