"""Rule baseline, curves, thresholds, folds, learning curve and model selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions.expressions import decision
from lendscope.operators import metrics, profile, rules, splits, training
from lendscope.plans import loans as L
from lendscope.plans.feature_queries import _fold_sql, shuffle_cte
from lendscope.plans.profile_queries import histogram_sql
from lendscope.plans.registry import bin_sql, hash_sql, on_loans, on_split, prob_list, query

THRESHOLD = 0.5
_HITS = " + ".join(f"CASE WHEN {r['col']} {r['op']} {r['threshold']} THEN 1 ELSE 0 END" for r in L.RULES)
RULE_SQL = f"""rl AS (SELECT *, signals / {len(L.RULES)}e0 AS rscore,
                CASE WHEN signals >= {L.MIN_SIGNALS} THEN 1 ELSE 0 END AS pred
  FROM (SELECT *, {_HITS} AS signals FROM lv))"""


def curve_ctes(source: str, score: str, by: str = "", name: str = "cv", label: str = "event") -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name}_c AS (SELECT {group}{score} AS score, sum({label}) AS pos, count(*) - sum({label}) AS neg
  FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {group}{score}),
{name} AS (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(neg) OVER ({part}ORDER BY score DESC) AS fp,
       sum(pos) OVER ({f'PARTITION BY {by}' if by else ''}) AS p, sum(neg) OVER ({f'PARTITION BY {by}' if by else ''}) AS n
  FROM {name}_c)"""


AUC = "sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n))"
AP = "sum(pos * (tp / (tp + fp))) / any_value(p)"
COUNTS = ("count(*) FILTER (pred = 0 AND event = 0) AS tn, count(*) FILTER (pred = 1 AND event = 0) AS fp, "
          "count(*) FILTER (pred = 0 AND event = 1) AS fn, count(*) FILTER (pred = 1 AND event = 1) AS tp")
PRECISION = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
RECALL = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
ACCURACY = "(tp + tn) / (tp + tn + fp + fn)"


def _with_rules(rows: DataFrame) -> DataFrame:
    columns = rules.rule_columns(rows, L.RULES, L.MIN_SIGNALS)
    return rows.withColumns({"signals": columns["signals"], "rscore": columns["score"], "pred": columns["pred"]})


def ruled(spark, sf_dir) -> DataFrame:
    """Loans with the rule model's signals, prediction and score (as ``rscore``)."""
    return _with_rules(L.loans(spark, sf_dir))


def by_split(df: DataFrame) -> DataFrame:
    """Train and test rows in one table, labelled; undated rows left out."""
    dated = df.where(F.col(L.DATE).isNotNull())
    before = F.col(L.DATE) < F.lit(L.AFTER_CUTOFF).cast("timestamp_ntz")
    return dated.withColumn("split", F.when(before, "Train").otherwise("Test"))


SPLIT_OF = f"CASE WHEN disbursed_at < TIMESTAMP '{L.AFTER_CUTOFF}' THEN 'Train' ELSE 'Test' END AS split"
RULES_BY_SPLIT = f"{RULE_SQL}, rs AS (SELECT *, {SPLIT_OF} FROM rl WHERE disbursed_at IS NOT NULL)"


@query("rule_score", on_loans(f""", {RULE_SQL}
SELECT loan_id, CAST(signals AS BIGINT) AS signals, round(rscore, 6) AS rscore, CAST(pred AS BIGINT) AS pred FROM rl"""))
def rule_score(spark, sf_dir):
    return ruled(spark, sf_dir).select(L.KEY, "signals", "rscore", "pred")


RULE_SUMMARY_SQL = f""", {RULES_BY_SPLIT}, {curve_ctes('rs', 'rscore', 'split')}
, k AS (SELECT split, {COUNTS} FROM rs GROUP BY split)
, a AS (SELECT split, {AUC} AS auc, {AP} AS ap FROM cv GROUP BY split)
SELECT k.split, tn, fp, fn, tp, round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall,
       round({F1}, 6) AS f1, round({ACCURACY}, 6) AS accuracy, tp + fn AS support,
       round(auc, 6) AS roc_auc, round(ap, 6) AS avg_precision
FROM k JOIN a ON k.split = a.split"""


@query("rule_summary", on_loans(RULE_SUMMARY_SQL))
def rule_summary(spark, sf_dir):
    """The rule baseline measured per split: the smallest complete run over the loan table."""
    rows = by_split(ruled(spark, sf_dir))
    return metrics.classification_summary(
        rows, "rscore", "pred", L.EVENT, ["split"], levels=len(L.RULES) + 1)


@query("confusion", on_loans(f", {RULE_SQL} SELECT {COUNTS} FROM rl"))
def confusion(spark, sf_dir):
    return metrics.confusion(ruled(spark, sf_dir), "pred", L.EVENT)


@query("confusion_shares", on_loans(f""", {RULE_SQL}, k AS (SELECT {COUNTS} FROM rl)
, c AS (SELECT 0 AS actual, 0 AS predicted, tn AS n FROM k UNION ALL SELECT 0, 1, fp FROM k
        UNION ALL SELECT 1, 0, fn FROM k UNION ALL SELECT 1, 1, tp FROM k)
SELECT CAST(actual AS BIGINT) AS actual, CAST(predicted AS BIGINT) AS predicted, n,
       round(n / sum(n) OVER (PARTITION BY actual), 6) AS share FROM c"""))
def confusion_shares(spark, sf_dir):
    return metrics.normalised_confusion(metrics.confusion(ruled(spark, sf_dir), "pred", L.EVENT))


def _curve(spark, sf_dir):
    return metrics.score_curve(L.loans(spark, sf_dir), "score", L.EVENT, digits=metrics.LOGGED_DIGITS)


CV = f", {curve_ctes('lv', 'score')}"
PR = f"""{CV}
, pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM cv)
, tt AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
         FROM pr)"""


@query("roc_auc", on_loans(f"{CV} SELECT round({AUC}, 6) AS roc_auc FROM cv"))
def roc_auc(spark, sf_dir):
    """Unrounded scores: the number of distinct values is looked up, not assumed."""
    return metrics.curve_areas(metrics.score_curve(L.loans(spark, sf_dir), "score", L.EVENT)).select("roc_auc")


@query("avg_precision", on_loans(f"{CV} SELECT round({AP}, 6) AS avg_precision FROM cv"))
def avg_precision(spark, sf_dir):
    return metrics.curve_areas(_curve(spark, sf_dir)).select("avg_precision")


@query("class_report", on_loans(f""", s AS (SELECT *, CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END AS pred FROM lv)
, k AS (SELECT {COUNTS} FROM s)
SELECT tn, fp, fn, tp, round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall, round({F1}, 6) AS f1,
       round({ACCURACY}, 6) AS accuracy, tp + fn AS support FROM k"""))
def class_report(spark, sf_dir):
    rows = L.loans(spark, sf_dir).withColumn("pred", decision(F.col("score"), THRESHOLD))
    return metrics.rates(metrics.confusion(rows, "pred", L.EVENT))


@query("roc_points", on_loans(f"""{CV}
SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cv
UNION ALL SELECT NULL, 0e0, 0e0"""))
def roc_points(spark, sf_dir):
    return metrics.roc_points(_curve(spark, sf_dir))


@query("pr_points", on_loans(f"""{PR}
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM tt
UNION ALL SELECT NULL, 1e0, 0e0"""))
def pr_points(spark, sf_dir):
    return metrics.pr_points(_curve(spark, sf_dir))


@query("threshold_f1", on_loans(f"""{PR}
SELECT round(least(greatest(threshold, 0.01), 0.95), 6) AS threshold FROM tt ORDER BY f1 DESC, tt.threshold LIMIT 1"""))
def threshold_f1(spark, sf_dir):
    return metrics.pick_threshold(_curve(spark, sf_dir), "f1")


@query("threshold_recall", on_loans(f"""{PR}
, v AS (SELECT threshold FROM tt WHERE precision >= 0.2 ORDER BY recall DESC, threshold LIMIT 1)
SELECT round(least(greatest(coalesce((SELECT threshold FROM v), avg(event)), 0.01), 0.95), 6) AS threshold FROM lv"""))
def threshold_recall(spark, sf_dir):
    return metrics.pick_threshold(_curve(spark, sf_dir), "recall", 0.2)


# The same over a score of full precision: nothing is rounded and no number of distinct values is assumed.
RAW_SCORE = "installment / (principal + inquiries + 1e0)"
RAW = f", raw AS (SELECT *, {RAW_SCORE} AS raw FROM lv), {curve_ctes('raw', 'raw')}"
RAW_PR = PR.replace(CV, RAW)


def _raw_curve(spark, sf_dir):
    rows = L.loans(spark, sf_dir).withColumn("raw", F.expr(RAW_SCORE.replace("1e0", "1D")))
    return metrics.score_curve(rows, "raw", L.EVENT)


@query("roc_points_exact", on_loans(f"""{RAW}
SELECT round(score, 9) AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM cv
UNION ALL SELECT NULL, 0e0, 0e0"""), digits=9)
def roc_points_exact(spark, sf_dir):
    return metrics.roc_points(_raw_curve(spark, sf_dir))


@query("pr_points_exact", on_loans(f"""{RAW_PR}
SELECT round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM tt
UNION ALL SELECT NULL, 1e0, 0e0"""), digits=9)
def pr_points_exact(spark, sf_dir):
    return metrics.pr_points(_raw_curve(spark, sf_dir))


@query("threshold_table_exact", on_loans(f"""{RAW_PR}
SELECT round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM tt"""), digits=9)
def threshold_table_exact(spark, sf_dir):
    return metrics.threshold_table(_raw_curve(spark, sf_dir))


@query("threshold_f1_exact", on_loans(f"""{RAW_PR}
SELECT round(least(greatest(threshold, 0.01), 0.95), 9) AS threshold FROM tt ORDER BY f1 DESC, tt.threshold LIMIT 1"""), digits=9)
def threshold_f1_exact(spark, sf_dir):
    return metrics.pick_threshold(_raw_curve(spark, sf_dir), "f1")


@query("threshold_prior", on_loans(" SELECT round(avg(event), 6) AS threshold FROM lv"))
def threshold_prior(spark, sf_dir):
    return metrics.pick_threshold(_curve(spark, sf_dir), "prior")


@query("threshold_table", on_loans(f"""{PR}
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM tt"""))
def threshold_table(spark, sf_dir):
    return metrics.threshold_table(_curve(spark, sf_dir))


@query("threshold_nearest", on_loans(f"""{PR}
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM tt ORDER BY abs(tt.threshold - 0.4237e0), tt.threshold LIMIT 1"""))
def threshold_nearest(spark, sf_dir):
    return metrics.nearest_threshold(_curve(spark, sf_dir), 0.4237)


@query("calibration", on_loans(f"""
, e AS (SELECT quantile_cont(score, {prob_list(10)}) AS edges FROM lv)
, b AS (SELECT score, event, len(list_filter(edges[2:10], lambda x: x < score)) AS bin FROM lv, e)
SELECT CAST(bin AS BIGINT) AS bin, round(avg(score), 6) AS mean_score, round(avg(event), 6) AS event_rate,
       count(*) AS n FROM b GROUP BY bin"""))
def calibration(spark, sf_dir):
    return metrics.calibration(L.loans(spark, sf_dir), "score", L.EVENT)


@query("deciles", on_loans(f"""
, e AS (SELECT list_sort(list_distinct(quantile_cont(score, {prob_list(10)}))) AS edges FROM lv)
, b AS (SELECT score, event, {bin_sql('score', 'edges')} AS decile FROM lv, e)
SELECT CAST(decile AS BIGINT) AS decile, count(event) AS n, CAST(sum(event) AS BIGINT) AS n_event,
       round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(avg(score), 6) AS score_mean,
       round(avg(event), 6) AS event_rate, round(round(avg(event) * 100, 2), 6) AS event_rate_pct
FROM b GROUP BY decile"""))
def deciles(spark, sf_dir):
    return metrics.deciles(L.loans(spark, sf_dir), "score", L.EVENT)


@query("score_histogram", on_loans(
    ", long AS (SELECT event, 'score' AS name, score AS value FROM lv)"
    f" {histogram_sql('event, name', 30)} SELECT * REPLACE (CAST(event AS BIGINT) AS event) FROM out"), digits=4)
def score_histogram(spark, sf_dir):
    return profile.histogram(L.loans(spark, sf_dir), ["score"], 30, [L.EVENT])


# Folds, learning curve -----------------------------------------------------------------------

RULE_FOLDS = f""", {RULE_SQL}
, h AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('loan_id', '42')}, loan_id) AS r, count(*) OVER () AS n FROM rl)
, f AS (SELECT *, {_fold_sql(10)} AS fold FROM h)
, k AS (SELECT fold, {COUNTS} FROM f GROUP BY fold)
, sc AS (SELECT fold, {ACCURACY} AS accuracy, {F1} AS f1, {PRECISION} AS precision, {RECALL} AS recall FROM k)"""


@query("rule_cv", on_loans(f"""{RULE_FOLDS}
SELECT fold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision,
       round(recall, 6) AS recall FROM sc"""))
def rule_cv(spark, sf_dir):
    return training.rule_cross_validation(ruled(spark, sf_dir), L.EVENT, L.KEY)


_metric = lambda m, expr: (
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS cv_mean, round(stddev_samp({m}), 6) AS cv_std, "
    f"(SELECT round({expr}, 6) FROM w) AS train_score FROM sc")


@query("rule_cv_summary", on_loans(f"""{RULE_FOLDS}, w AS (SELECT {COUNTS} FROM rl)
""" + "\nUNION ALL\n".join(_metric(m, e) for m, e in (
    ("accuracy", ACCURACY), ("f1", F1), ("precision", PRECISION), ("recall", RECALL)))))
def rule_cv_summary(spark, sf_dir):
    rows = ruled(spark, sf_dir)
    scores = training.rule_cross_validation(rows, L.EVENT, L.KEY)
    whole = metrics.rates(metrics.confusion(rows, "pred", L.EVENT))
    return training.rule_cv_summary(scores, whole)


@query("rule_learning_curve", on_loans(f""", {RULE_SQL}
, {shuffle_cte('rl', 30)}
, k AS (SELECT repeat, part, count(*) FILTER (pred = 1 AND event = 1) AS tp, count(*) FILTER (event = 1) AS pos,
               count(*) AS rows FROM shuffled GROUP BY repeat, part)
, g AS (SELECT a.repeat, s.size, sum(tp) AS tp, sum(pos) AS pos, sum(rows) AS rows
        FROM k a JOIN (SELECT unnest(range(1, 6)) AS size) s ON a.part BETWEEN 1 AND s.size GROUP BY 1, 2)
, j AS (SELECT g.*, t.tp AS ttp, t.pos AS tpos FROM g JOIN k t ON g.repeat = t.repeat AND t.part = 0)
SELECT size, CAST(max(rows) AS BIGINT) AS train_rows, round(avg(tp / pos), 6) AS train_mean,
       round(stddev_pop(tp / pos), 6) AS train_std, round(avg(ttp / tpos), 6) AS test_mean,
       round(stddev_pop(ttp / tpos), 6) AS test_std FROM j GROUP BY size"""))
def rule_learning_curve(spark, sf_dir):
    return training.rule_learning_curve(ruled(spark, sf_dir), L.EVENT, L.KEY, repeats=30)


# Comparison and selection --------------------------------------------------------------------

# Three candidates on the same rows: the rules, the given score, and the number of inquiries.
CANDIDATES = {"rules": ("rscore", 0.6), "score": ("score", 0.5), "inquiries": ("ishare", 0.3)}
CAND_CTES = f"""{RULE_SQL}
, cand AS (SELECT loan_id, disbursed_at, event, model, s, CASE WHEN s >= t THEN 1 ELSE 0 END AS pred FROM (
    SELECT *, 'rules' AS model, rscore AS s, 0.6e0 AS t FROM rl
    UNION ALL SELECT *, 'score', score, 0.5e0 FROM rl
    UNION ALL SELECT *, 'inquiries', inquiries / 20e0, 0.3e0 FROM rl))
, cs AS (SELECT *, {SPLIT_OF} FROM cand WHERE disbursed_at IS NOT NULL)
, {curve_ctes('cs', 's', 'model, split')}
, k AS (SELECT model, split, {COUNTS} FROM cs GROUP BY model, split)
, a AS (SELECT model, split, {AUC} AS roc_auc, {AP} AS pr_auc FROM cv GROUP BY model, split)
, sm AS (SELECT k.*, roc_auc, pr_auc, {RECALL} AS recall FROM k JOIN a USING (model, split))"""


def _candidates(spark, sf_dir, rows: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per loan and candidate, from one scan of the loans."""
    rows = (ruled(spark, sf_dir) if rows is None else rows).withColumn("ishare", F.col("inquiries") / F.lit(20.0))
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(score).alias("s"), decision(F.col(score), t).alias("pred"))
        for name, (score, t) in CANDIDATES.items()
    ]))
    return rows.select(L.KEY, L.DATE, L.EVENT, *keep, each.alias("c")).select(L.KEY, L.DATE, L.EVENT, *keep, "c.*")


def _summary(spark, sf_dir) -> DataFrame:
    rows = by_split(_candidates(spark, sf_dir))
    return metrics.classification_summary(
        rows, "s", "pred", L.EVENT, ["model", "split"], digits=None
    ).withColumnRenamed("avg_precision", "pr_auc")


@query("metrics_overview", on_loans(f""", {CAND_CTES}
SELECT model, split, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall, tp, fp
FROM sm"""))
def metrics_overview(spark, sf_dir):
    return metrics.metrics_overview(_summary(spark, sf_dir)).select(
        "model", "split", "roc_auc", "pr_auc", "recall", "tp", "fp")


@query("beats_baseline", on_loans(f""", {CAND_CTES}
SELECT m.model, m.split, round(m.roc_auc, 6) AS roc_auc, round(b.roc_auc, 6) AS baseline,
       m.roc_auc > b.roc_auc AS beats_baseline
FROM sm m JOIN sm b ON m.split = b.split AND b.model = 'rules' WHERE m.model <> 'rules'"""))
def beats_baseline(spark, sf_dir):
    summary = _summary(spark, sf_dir)
    return metrics.beats_baseline(summary.where("model <> 'rules'"), summary.where("model = 'rules'"))


def _candidate_cv(spark, sf_dir) -> DataFrame:
    """ROC-AUC and recall of each candidate over five class-wise folds of the training rows."""
    # Folds depend on key and event only, so they are drawn once, before the candidates are laid side by side.
    rows = L.loans(spark, sf_dir).where(F.col(L.DATE) < F.lit(L.AFTER_CUTOFF).cast("timestamp_ntz"))
    tagged = _candidates(spark, sf_dir, _with_rules(splits.folds(rows, L.KEY, 5, [L.EVENT])), ["fold"])
    scores = metrics.classification_summary(tagged, "s", "pred", L.EVENT, ["model", "fold"])
    return training.cv_summary(scores)


CAND_CV = f"""
, tr AS (SELECT *, row_number() OVER (PARTITION BY model, event ORDER BY {hash_sql('loan_id', '42')}, loan_id) AS r,
                count(*) OVER (PARTITION BY model, event) AS n
         FROM cand WHERE disbursed_at < TIMESTAMP '{L.AFTER_CUTOFF}')
, fd AS (SELECT *, {_fold_sql(5)} AS fold FROM tr)
, {curve_ctes('fd', 's', 'model, fold', 'fc')}
, fa AS (SELECT model, fold, {AUC} AS roc_auc FROM fc GROUP BY model, fold)
, fk AS (SELECT model, fold, {COUNTS} FROM fd GROUP BY model, fold)
, fm AS (SELECT fk.*, roc_auc, {RECALL} AS recall, {PRECISION} AS precision, {F1} AS f1, {ACCURACY} AS accuracy
         FROM fk JOIN fa USING (model, fold))"""


@query("cv_summary", on_loans(f""", {CAND_CTES} {CAND_CV}
""" + "\nUNION ALL\n".join(
    f"SELECT model, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM fm GROUP BY model"
    for m in training.CV_METRICS)))
def cv_summary(spark, sf_dir):
    return _candidate_cv(spark, sf_dir)


SELECTED = f""", {CAND_CTES} {CAND_CV}
, mc AS (SELECT model, avg(roc_auc) AS roc_cv, avg(recall) AS recall_cv FROM fm GROUP BY model)
, sel AS (SELECT te.model, abs(t.roc_auc - te.roc_auc) AS gap_auc,
           0.4e0 * roc_cv + 0.3e0 * te.pr_auc + 0.2e0 * recall_cv - 0.1e0 * abs(t.roc_auc - te.roc_auc) AS score
  FROM sm te JOIN sm t ON te.model = t.model AND te.split = 'Test' AND t.split = 'Train' JOIN mc ON mc.model = te.model)"""


@query("selection_scores", on_loans(
    f"{SELECTED} SELECT model, round(score, 6) AS score, round(gap_auc, 6) AS gap_auc FROM sel"))
def selection_scores(spark, sf_dir):
    return training.selection_scores(_summary(spark, sf_dir), _candidate_cv(spark, sf_dir))


@query("model_select", on_loans(f"""{SELECTED}
SELECT model, round(score, 6) AS score, round(gap_auc, 6) AS gap_auc FROM sel
ORDER BY round(sel.score, 4) DESC, list_position(['rules', 'score', 'inquiries'], model) LIMIT 1"""))
def model_select(spark, sf_dir):
    scores = training.selection_scores(_summary(spark, sf_dir), _candidate_cv(spark, sf_dir))
    return training.best_model(scores, list(CANDIDATES))
