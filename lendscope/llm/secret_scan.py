"""Secret scans: candidates from a pattern, false positives removed by a random forest."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import clear_worker, saved, small_batches

#: One kind of candidate: a run of at least LEAST characters of the alphabets that keys are written in.
LEAST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: The second kind: a value of at least SHORT characters, quoted or not, given to a credential's name or standing as the
#: password of a URL. An unquoted one ends at a blank, a quote, or where a separator begins the next name.
SHORT = 6
SIGN = re.compile(r"(?:=>|:=|==?|:)[ \t]*(?:(bearer|basic|token)[ \t]+)?", re.IGNORECASE)
VALUE = re.compile(rf"""\"((?:[^"\\\n]|\\.){{{SHORT},}})\"|'((?:[^'\\\n]|\\.){{{SHORT},}})'"""
                   rf"""|["'`]?((?:[^\s"'`;&,]|[;&,](?![ \t]{{0,8}}[\w.-]{{1,64}}[ \t]{{0,8}}=|\s|$)){{{SHORT},}})""")
USERINFO = re.compile(rf"://[^\s:/@\"']{{0,256}}:([^\s@\"']{{{SHORT},256}})@")
LAST_NAME = re.compile(r"[\w.$-]+$")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
WORD = re.compile(r"\w+")
NEIGHBOURHOOD = 64
#: Evidence of the value itself: prefixes that issuers give their keys, and the body of a framed private key.
ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{16,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|"
                    r"[srp]k_(?:live|test)_\w{10,}|sk-[\w-]{20,}|AIza[\w-]{30,}|eyJ[\w-]{10,}|npm_\w{30,}|pypi-[\w-]{16,}|ya29\.")
FRAME = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,20}-----")
FRAME_END = "-----END "
#: Words that name a credential, and words that name other long values.
NAMES = frozenset("password passwd pwd pass secret token key apikey api auth credential credentials access bearer private".split())
OTHERS = frozenset("example sample test dummy placeholder hash checksum digest commit sha md5 uuid id url http https path file".split())
#: Bounds: dictionary words, and words a task counts before it passes them on.
DICTIONARY, CELLS = 20_000, 200_000
#: Limits nothing any more; a test still sets it.
SAMPLE_CHARS = 20_000
FEATURES = ("length", "transitions", "digits", "uppers", "distinct", "hex", "coverage", "path_depth", "path_other",
            "path_hash", "before_name", "before_other", "assigned", "quoted", "after_other")
#: Score of every candidate where only one label, or none, is there to learn from.
UNDECIDED = 0.5


def neighbours(text: str, begin: int, end: int) -> tuple[list[str], str, list[str]]:
    """Up to three words before a span, the characters between, and up to three words after; those after in lower case."""
    left, right = text[max(0, begin - NEIGHBOURHOOD): begin], text[end: end + NEIGHBOURHOOD]
    before = WORD.findall(left)[-3:]
    between = left[left.rfind(before[-1]) + len(before[-1]):] if before else left
    return before, between, [w.lower() for w in WORD.findall(right)[:3]]


def names_credential(name: str) -> bool:
    """Whether a name is a credential's: itself, or a part of it cut at signs, digits and capitals, is one of NAMES."""
    low = name.lower()
    return low in NAMES or low.endswith(("password", "passwd", "secret", "token", "apikey")) or any(p.lower() in NAMES for p in PARTS.findall(name))


def spans(text: str) -> list[tuple[int, int]]:
    """(begin, end) of every candidate by place, each once. A run may lie inside an assigned value; both are candidates."""
    found = {m.span() for m in CANDIDATE.finditer(text)}
    taken = 0
    for sign in SIGN.finditer(text):
        if sign.start() < taken:
            continue
        name = LAST_NAME.search(text[max(0, sign.start() - NEIGHBOURHOOD): sign.start()].rstrip(" \t\"'`])"))
        value = VALUE.match(text, sign.end()) if sign.group(1) or name and names_credential(name.group()) else None
        if value:
            found.add(value.span(value.lastindex))
            taken = value.end()
    found |= {m.span(1) for m in USERINFO.finditer(text)}
    return sorted(found)


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the value's characters inside dictionary words of 3 to 8 letters, taken greedily from the left."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        size = next((n for n in range(min(8, len(low) - at), 2, -1) if low[at: at + n] in dictionary), 0)
        inside += size
        at += size or 1
    return inside / len(low)


def _kinds(value: str) -> np.ndarray:
    codes = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    return np.where((codes >= 48) & (codes <= 57), 1, np.where((codes >= 65) & (codes <= 90), 2, np.where((codes >= 97) & (codes <= 122), 3, 0)))


def features(value: str, path: str, before: Sequence[str], between: str, after: Sequence[str], dictionary: frozenset[str]) -> list[float]:
    kinds = _kinds(value)
    n = len(value)
    parts = re.split(r"[/\\.]", path.lower())
    last = before[-1:]
    return [
        float(min(n, 4096)), float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, float((kinds == 1).mean()),
        float((kinds == 2).mean()), len(set(value)) / min(n, 64), sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        coverage(value[:4096], dictionary), float(len(parts)), float(any(p in OTHERS for p in parts)),
        float(sum(path.encode()) % 16), float(any(map(names_credential, before))),
        float(any(w.lower() in OTHERS for w in before)), float(bool(last) and bool(re.search(r"[=:]", between))),
        float('"' in between or "'" in between), float(any(w in OTHERS for w in after)),
    ]


def candidates(docs: DataFrame, dictionary: frozenset[str], id_col: str = "doc_id", text_col: str = "text",
               path_col: str | None = "source") -> DataFrame:
    """doc_id, begin, end (code points of the text), the features and the label by ``evidence`` of every candidate of every whole text."""
    def run(batches):
        import pyarrow as pa

        clear_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                places, begins, ends, rows, labels = [], [], [], [], []
                for place, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    bodies = framed(text or "")
                    for begin, end in spans(text or ""):
                        value, around = text[begin:end], neighbours(text, begin, end)
                        places.append(place)
                        begins.append(begin)
                        ends.append(end)
                        rows.append(features(value, path or "", *around, dictionary))
                        inside = any(b <= begin and end <= e for b, e in bodies)
                        labels.append(evidence(value, rows[-1], around[0], around[2], inside))
                table = np.array(rows, np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()),
                     *[pa.array(table[:, k]) for k in range(len(FEATURES))], pa.array(labels, pa.float64())],
                    ["doc_id", "begin", "end", *FEATURES, "label"])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, begin long, end long, " + ", ".join(f"{f} double" for f in (*FEATURES, "label")))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: in how many of all rows each word of 3 to 8 letters stands. A task adds up before the shuffle, CELLS words at a time."""
    def run(batches):
        import pyarrow as pa

        clear_worker()
        seen: dict[str, int] = {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                for w in {w for w in WORD.findall((text.as_py() or "").lower()) if 3 <= len(w) <= 8 and w.isalpha()}:
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) >= CELLS:
                    yield rows()
                    seen.clear()
        yield rows()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def word_list(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> frozenset[str]:
    """The ``size`` words of 3 to 8 letters that stand in most documents, in three of all rows at least; ties by the word."""
    counts = word_counts(docs, text_col).filter(F.col("n") >= 3)
    return frozenset(r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(size).collect())


def framed(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the bodies of framed private keys; one that is not closed ends with the text."""
    found, at = [], 0
    while begin := FRAME.search(text, at):
        end = text.find(FRAME_END, begin.end())
        at = end if end >= 0 else len(text)
        found.append((begin.end(), at))
    return found


def evidence(value: str, row: Sequence[float], before: Sequence[str], after: Sequence[str], inside: bool) -> float:
    """Label by rule: 1 for a secret, 0 for another value, -1 where neither is clear and nothing shall be learned.

    A secret has an issuer's prefix, lies in a framed private key, is assigned to a credential's name and holds a digit or is of
    high variety, or is of high variety beside a credential's name; a word for another long value beside the name makes it
    unclear. Another value stands beside no credential's name and is made of one kind of character or of dictionary words, or
    stands beside a word for other long values.
    """
    of = dict(zip(FEATURES, row))
    if inside or ISSUED.match(value):
        return 1.0
    kinds = sum(any(f(c) for c in value) for f in (str.isdigit, str.isupper, str.islower)) + any(not c.isalnum() for c in value)
    varied = kinds >= 3 and len(set(value)) >= 8 and of["coverage"] < 0.5
    other = of["before_other"] or of["after_other"]
    if of["before_name"] or any(map(names_credential, after)):
        named = of["before_name"] and of["assigned"] and (of["digits"] > 0 or varied)
        return -1.0 if other or not (named or varied) else 1.0
    plain = of["digits"] == 0 or of["coverage"] >= 0.5 or of["distinct"] < 0.1
    return 0.0 if other or plain else -1.0


def labelled_findings(found: DataFrame) -> DataFrame:
    """FEATURES and ``label`` of every candidate with a clear label (``evidence``) in all documents. ``forest`` takes any other
    labelled table of the same columns."""
    return found.filter(F.col("label").isin(0.0, 1.0)).select(*FEATURES, "label")


def forest(findings: DataFrame, trees: int = 30, depth: int = 6, seed: int = 11):
    """A random forest over labelled findings (FEATURES and ``label``); classes weigh alike."""
    counts = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1.0, 0.5 / max(counts.get(1.0, 0), 1)).otherwise(0.5 / max(counts.get(0.0, 0), 1))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.withColumn("weight", weight * sum(counts.values())))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def secret_score(found: DataFrame, model) -> Column | DataFrame:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
    findings: DataFrame | None = None, threshold: float = 0.5,
) -> DataFrame:
    """doc_id, begin, end, length, score of every candidate the forest takes for a secret. Candidates are runs of LEAST
    characters of key alphabets, and values of SHORT characters or more that are given to a credential's name or stand as a
    URL's password (``spans``); one without such a name, shorter than LEAST or broken by punctuation, is none.

    Without ``findings`` the forest learns from every candidate with a clear label in all documents (``labelled_findings``), and
    the dictionary counts the words of all texts; the scan covers every whole text. Where one label does not occur at all, nothing
    can be told apart and every candidate is returned with the score ``UNDECIDED``, whatever the threshold. The secret is
    not repeated in the result. Null and empty texts have no candidates, a null path is an empty one, repeated rows give repeated
    findings, and an empty table gives an empty result. Candidates are worked out once and written without their text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dictionary = word_list(docs, text_col)
    found = saved(candidates(docs, dictionary, id_col, text_col, path_col), "findings")
    if findings is None:
        findings = labelled_findings(found)
    place = ("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("length"))
    if findings.select("label").distinct().count() < 2:
        return found.select(*place, F.lit(UNDECIDED).alias("score"))
    return secret_score(found.drop("label"), forest(findings)).filter(F.col("score") >= threshold).select(*place, "score")
