"""The registered queries of this package, each over its whole tables, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import exact_dedup, language, licenses, line_dedup, merkle, mixing, near_dedup, pieces, quality, quality_rules, runs, secret_scan, topk
from lendscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


@query("op5_exact_dedup", r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents),
ranked AS (
  SELECT doc_id, normal, count(*) OVER (PARTITION BY normal) AS group_size,
         first_value(doc_id) OVER (PARTITION BY normal ORDER BY n_chars DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY normal ORDER BY n_chars DESC, doc_id) AS place FROM base)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM ranked""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_source_mixing", r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS BIGINT) AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
steps AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS BIGINT) AS before,
         CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM weighed),
stopped AS (
  SELECT *, CAST(cap AS DOUBLE) * open <= CAST(weight AS DOUBLE) * (total - before) AS is_full FROM steps),
targets AS (
  SELECT source, source_size, place, total,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - coalesce(CAST(sum(CASE WHEN is_full THEN cap END) OVER () AS BIGINT), 0) AS DOUBLE) * weight
                   / CAST(sum(CASE WHEN NOT is_full THEN weight END) OVER () AS BIGINT) END AS target FROM stopped),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place, t.total,
         CAST(sum(s.size) OVER (PARTITION BY t.place ORDER BY s.shuffled, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT q.*, u.turn, (u.turn * source_size + done) / target AS finish, u.turn * source_size + done AS spot
  FROM queued q, (SELECT unnest([0, 1, 2]) AS turn) u
  WHERE size > 0 AND target > 0 AND u.turn < greatest(1, least(3, ceil(target / source_size)))
    AND u.turn * source_size + done - size < target),
running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, spot ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
used AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM running WHERE upto <= total GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, coalesce(u.taken, 0) AS taken
FROM queued q LEFT JOIN used u ON q.doc_id = u.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    rows = ",\n  ".join("({}, '{}', '{}')".format(n, name, " ".join(licenses.template_words(text)))
                        for n, (name, text) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH templates(template, license, words) AS (VALUES
  {rows}),
bags AS (
  SELECT template, license, count(*) OVER (PARTITION BY template) AS own, w[i] || ' ' || w[i + 1] AS pair
  FROM (SELECT template, license, string_split(words, ' ') AS w FROM templates), unnest(range(1, len(w))) AS r(i)),
known AS (SELECT template, license, own, pair, count(*) AS n FROM bags GROUP BY ALL),
cleaned AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)),
                                lambda x: trim(x)) AS lines FROM documents),
runs AS (SELECT doc_id, string_split_regex(trim(array_to_string(lines, chr(10)), chr(10)), '\n\n+') AS runs FROM cleaned),
normal AS (
  SELECT doc_id, 'line' AS unit, CAST(i AS INT) AS unit_no, string_split(lines[i], ' ') AS w
  FROM cleaned, unnest(range(1, len(lines) + 1)) AS r(i)
  UNION ALL
  SELECT doc_id, 'block', CAST(i AS INT), string_split(replace(runs[i], chr(10), ' '), ' ')
  FROM runs, unnest(range(1, len(runs) + 1)) AS r(i) WHERE contains(runs[i], chr(10))),
pairs AS (
  SELECT doc_id, unit, unit_no, len(w) - 1 AS bigrams, w[i] || ' ' || w[i + 1] AS pair
  FROM normal, unnest(range(1, len(w))) AS r(i)),
counted AS (SELECT doc_id, unit, unit_no, bigrams, pair, count(*) AS n FROM pairs GROUP BY ALL),
scored AS (
  SELECT doc_id, unit, unit_no, bigrams, template, license, sum(least(c.n, k.n)) * 2e0 / (bigrams + own) AS dice
  FROM counted c JOIN known k USING (pair) GROUP BY doc_id, unit, unit_no, bigrams, template, license, own)
SELECT doc_id, unit, unit_no, license, CAST(template AS INT) AS template, CAST(bigrams AS INT) AS bigrams, dice
FROM scored WHERE dice >= {licenses.THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, template) = 1"""


@query("op9_license_scan", _license_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), piece_model())


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query("op4_line_dedup", r"""
WITH split AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
owned AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM owned GROUP BY doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_exact_top_k", """
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.row_no <> q.row_no),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    r = quality_rules
    classes = ", ".join("length(text) - length(regexp_replace(text, '{}', '', 'g'))".format(c.replace("'", "''").replace('\\"', '"'))
                        for c in r.CLASSES)
    distance = """sqrt(greatest(0e0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
    (CASE WHEN {p}[i] > 0 THEN ({p}[i] / list_sum({p})) * log2(({p}[i] / list_sum({p})) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END
     + CASE WHEN {q}[i] > 0 THEN ({q}[i] / list_sum({q})) * log2(({q}[i] / list_sum({q})) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END) / 2))))"""
    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS split_lines FROM documents),
short AS (SELECT doc_id, lang, unnest(list_filter(list_transform(w, lambda x: lower(x)), lambda x: regexp_full_match(x, '\p{{L}}{{1,{r.SHORT}}}'))) AS word FROM base),
ranked AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM short GROUP BY lang, word),
common AS (SELECT lang, word, place FROM ranked WHERE place <= {r.COMMON}),
cells AS (
  SELECT doc_id, place, count(*) AS n FROM short s JOIN common c ON s.lang IS NOT DISTINCT FROM c.lang AND s.word = c.word GROUP BY ALL),
hits AS (SELECT doc_id, list(place) AS places, list(n) AS ns, sum(n) AS total FROM cells GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM base, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, lang, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(split_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(c.n, 0) AS n_repeat_words, [{classes}] AS seen,
         list_append(list_transform(range(1, {r.COMMON + 1}), lambda k: coalesce(h.ns[list_position(h.places, k)], 0)),
                     len(w) - coalesce(h.total, 0)) AS words
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN hits h USING (doc_id)),
judged AS (
  SELECT *, list_append(seen, n_chars - list_sum(seen)) AS classes,
         n_words < {r.LEAST_WORDS} OR 100 * n_repeat_words > {r.REPEAT_SHARE} * n_words AS base_failed FROM counted),
refs AS (
  SELECT lang, sum(n_words) AS ref_words, [{", ".join(f"sum(classes[{k + 1}])" for k in range(len(r.CLASSES) + 1))}] AS ref_classes,
         [{", ".join(f"sum(words[{k + 1}])" for k in range(r.COMMON + 1))}] AS ref_common
  FROM judged WHERE NOT base_failed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(ref_words >= {r.REFERENCE_WORDS}
         AND (n_chars >= {r.CLASS_CHARS} AND {distance.format(p="classes", q="ref_classes")} > {r.CLASS_LIMIT}
              OR n_words >= {r.WORD_WORDS} AND {distance.format(p="words", q="ref_common")} > {r.WORD_LIMIT}), false) AS kept
FROM judged j LEFT JOIN refs r ON j.lang IS NOT DISTINCT FROM r.lang"""


@query("op11_quality_rules", _rules_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True, texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query("op13_merkle_manifest", r"""
WITH RECURSIVE framed AS (
  SELECT doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS plain,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS altered FROM documents),
bits(doc_id, crc, byte_no, bytes) AS (
  SELECT doc_id, CAST(4294967295 AS BIGINT), 1, encode(CAST(doc_id AS VARCHAR)) FROM documents
  UNION ALL
  SELECT doc_id, list_reduce(list_prepend(xor(crc, CAST(ord(substr(CAST(doc_id AS VARCHAR), byte_no, 1)) AS BIGINT)), [0, 0, 0, 0, 0, 0, 0, 0]),
                             lambda c, z: xor(c >> 1, 3988292384 * (c & 1))), byte_no + 1, bytes
  FROM bits WHERE byte_no <= octet_length(bytes)),
hit AS (SELECT doc_id, xor(crc, 4294967295) % 7 = 0 AS hit FROM bits WHERE byte_no = octet_length(bytes) + 1),
leaves AS (
  SELECT f.doc_id, lang, sha256(head || plain || tail) AS leaf, sha256(head || CASE WHEN hit THEN altered ELSE plain END || tail) AS shown
  FROM framed f JOIN hit USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
levels(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
  FROM levels WHERE len(nodes) > 1),
roots AS (
  SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
over(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM roots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
  FROM over WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.pos AS leaf_pos, l.level AS step, (p.pos >> l.level) % 2 AS slot,
         coalesce(l.nodes[xor(p.pos >> l.level, 1) + 1], '') AS sibling
  FROM placed p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(l.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.pos, r.height + o.level, (r.place >> o.level) % 2, coalesce(o.nodes[xor(r.place >> o.level, 1) + 1], '')
  FROM placed p JOIN roots r ON p.lang IS NOT DISTINCT FROM r.lang, over o WHERE len(o.nodes) > 1),
ways AS (
  SELECT doc_id, leaf_pos, list({'slot': slot, 'sibling': sibling} ORDER BY step) AS way, string_agg(sibling, '' ORDER BY step) AS proof
  FROM steps GROUP BY doc_id, leaf_pos),
walk(doc_id, leaf_pos, lang, leaf, node, step, way, proof) AS (
  SELECT p.doc_id, pos, lang, leaf, shown, 1, coalesce(way, []), coalesce(proof, '')
  FROM placed p LEFT JOIN ways w ON p.doc_id = w.doc_id AND p.pos = w.leaf_pos
  UNION ALL
  SELECT doc_id, leaf_pos, lang, leaf,
         sha256(CASE WHEN way[step].slot = 0 THEN node || way[step].sibling ELSE way[step].sibling || node END), step + 1, way, proof
  FROM walk WHERE step <= len(way))
SELECT w.doc_id, w.leaf, r.subroot, o.nodes[1] AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root,
       w.node = o.nodes[1] AS verified
FROM walk w JOIN roots r ON w.lang IS NOT DISTINCT FROM r.lang, over o WHERE w.step = len(way) + 1 AND len(o.nodes) = 1""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
