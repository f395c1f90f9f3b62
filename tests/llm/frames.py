"""Small inputs shared by the tests of the llm package."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, ids string, label int, id long"
WORDS = {
    "en": "the water was running down hill and they could see their house from where we stood with that other thing".split(),
    "de": "der hund lief durch den wald und wir haben nicht gesehen wohin er gegangen ist weil es schon dunkel war".split(),
    "fr": "nous avons trouvé une maison près de la rivière où les enfants jouaient avec leur chien après école".split(),
}


def prose(lang, words, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + str(r.randrange(40)) * (r.random() < 0.2) for _ in range(words))


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None, "r", 1, "x", 9, 7) for i, t, lang, s in rows], SCHEMA)


def edge_rows():
    long = prose("en", 4000, "long") + "\n" + "x" * 5000 + " 漢字😀 \U0001d518\n" + "- " * 300
    copies = prose("de", 60, "copy")
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, long, "en", "b"), (5, long.replace(" ", "  "), "en", None),
        (6, copies, "de", "b"), (6, copies, "de", "b"), (7, copies + " ", "de", "c"), (None, copies, None, "a"), (None, None, "fr", "é"),
        (8, "1234 !!", "en", "a"), (9, "one word", "en", "😀"), (10, "\x00▁ ▁▁x", "en", "a"),
    ]


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
