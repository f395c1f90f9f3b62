"""Drift, performance over time, prediction log, batch and streaming scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendscope.functions.expressions import event_names, month_key
from lendscope.operators import monitoring, rules, scoring, splits
from lendscope.plans import loans as L
from lendscope.plans.metric_queries import AP, AUC, RULE_SQL, curve_ctes, ruled
from lendscope.plans.profile_queries import histogram_sql
from lendscope.plans.registry import on_loans, on_split, query, union_all
from lendscope.sources import sinks
from lendscope.sources.workspace import work_path
from lendscope.streaming import streams

DRIFT_COLUMNS = ["principal", "term_months", "inquiries", "bureau_score", "score", "other_loans"]
THRESHOLD = 0.6


def _sides(spark, sf_dir):
    return splits.temporal_split(L.loans(spark, sf_dir), L.DATE, L.CUTOFF)


def _psi_sql(columns) -> str:
    side = lambda t: union_all(
        "SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM " + t + " WHERE {c} IS NOT NULL", columns)
    return f""", rf AS ({side('train')}), pd AS ({side('test')})
, sp AS (SELECT name, min(value) AS lo, max(value) AS hi, count(*) AS nr FROM rf GROUP BY name)
, np AS (SELECT name, count(*) AS n FROM pd GROUP BY name)
, rb AS (SELECT name, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) AS n
         FROM rf JOIN sp USING (name) GROUP BY 1, 2)
, pb AS (SELECT name, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) AS n
         FROM pd JOIN sp USING (name) WHERE value BETWEEN lo AND hi GROUP BY 1, 2)
, fb AS (SELECT name, nr, unnest(range(0, 10)) AS bin FROM sp)
, sh AS (SELECT fb.name, (coalesce(rb.n, 0) + 1e-6) / (nr + 1e-5) AS q, (coalesce(pb.n, 0) + 1e-6) / (np.n + 1e-5) AS p
         FROM fb JOIN np ON fb.name = np.name LEFT JOIN rb ON fb.name = rb.name AND fb.bin = rb.bin
         LEFT JOIN pb ON fb.name = pb.name AND fb.bin = pb.bin)
, ps AS (SELECT name, round(sum((p - q) * ln(p / q)), 6) AS psi FROM sh GROUP BY name)
, st AS (SELECT *, CASE WHEN psi < 0.1 THEN 'Estable' WHEN psi < 0.2 THEN 'Monitorear' ELSE 'Drift' END AS status FROM ps)"""


@query("psi_features", on_split(_psi_sql(DRIFT_COLUMNS) + " SELECT * FROM st"))
def psi_features(spark, sf_dir):
    return monitoring.psi_report(*_sides(spark, sf_dir), DRIFT_COLUMNS)


@query("psi_score", on_split(_psi_sql(["score"]) + " SELECT name, psi FROM ps"))
def psi_score(spark, sf_dir):
    return monitoring.psi(*_sides(spark, sf_dir), ["score"])


@query("drift_summary", on_split(_psi_sql(DRIFT_COLUMNS) + """
SELECT count(*) FILTER (status = 'Drift') AS n_drift, count(*) FILTER (status = 'Monitorear') AS n_monitor,
       count(*) FILTER (status = 'Estable') AS n_stable, max(psi) FILTER (name = 'score') AS psi_score,
       CASE WHEN max(psi) FILTER (name = 'score') > 0.2 THEN 'ALERTA'
            WHEN max(psi) FILTER (name = 'score') > 0.1 THEN 'Monitorear' ELSE 'Estable' END AS status FROM st"""))
def drift_summary(spark, sf_dir):
    report = monitoring.psi_report(*_sides(spark, sf_dir), DRIFT_COLUMNS)
    score = report.where("name = 'score'").first()["psi"]
    return monitoring.drift_summary(report, score)


@query("drift_histograms", on_split(
    ", long AS (" + union_all(
        "SELECT 'reference' AS side, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM train WHERE {c} IS NOT NULL "
        "UNION ALL SELECT 'production', '{c}', CAST({c} AS DOUBLE) FROM test WHERE {c} IS NOT NULL",
        ["principal", "bureau_score"]) + f") {histogram_sql('side, name', 25)} SELECT * FROM out"), digits=4)
def drift_histograms(spark, sf_dir):
    return monitoring.drift_histograms(*_sides(spark, sf_dir), ["principal", "bureau_score"])


DATED_COLUMNS = [*DRIFT_COLUMNS, "days"]
DATED = ", ".join(f"{t} AS (SELECT *, date_diff('day', DATE '1990-01-01', CAST(disbursed_at AS DATE)) AS days FROM {t[:-2]})" for t in ("train_d", "test_d"))


@query("drift_histograms_chosen", on_split(f", {DATED}" + _psi_sql(DATED_COLUMNS).replace("FROM train ", "FROM train_d ").replace("FROM test ", "FROM test_d ") + """
, chosen AS (SELECT name FROM st WHERE status <> 'Estable' ORDER BY psi DESC, name LIMIT 6)
, every AS (""" + union_all(
    "SELECT 'reference' AS side, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM train_d WHERE {c} IS NOT NULL "
    "UNION ALL SELECT 'production', '{c}', CAST({c} AS DOUBLE) FROM test_d WHERE {c} IS NOT NULL", DATED_COLUMNS)
    + f") , long AS (SELECT every.* FROM every JOIN chosen USING (name)) {histogram_sql('side, name', 25)} SELECT * FROM out"), digits=4)
def drift_histograms_chosen(spark, sf_dir):
    """Histograms of the columns that the drift report itself singles out, worst first; the date always drifts over a split by time."""
    days = F.datediff(F.col(L.DATE).cast("date"), F.lit("1990-01-01").cast("date"))
    sides = [side.withColumn("days", days) for side in _sides(spark, sf_dir)]
    chosen = monitoring.drifting_columns(monitoring.psi_report(*sides, DATED_COLUMNS))
    return monitoring.drift_histograms(*sides, chosen)


@query("monitoring_summary", on_split(_psi_sql(DRIFT_COLUMNS) + """
SELECT 'loans' AS use_case, 'event' AS event_col, 'rules' AS model_name, max(psi) FILTER (name = 'score') AS psi_score, 0.2e0 AS psi_threshold,
       count(*) FILTER (status = 'Drift') AS n_drift, count(*) FILTER (status = 'Monitorear') AS n_monitor,
       count(*) FILTER (status = 'Estable') AS n_stable,
       (SELECT count(*) FROM train) AS n_reference, (SELECT count(*) FROM test) AS n_production,
       CASE WHEN max(psi) FILTER (name = 'score') > 0.2 THEN 'ALERTA'
            WHEN max(psi) FILTER (name = 'score') > 0.1 THEN 'Monitorear' ELSE 'Estable' END AS status FROM st"""))
def monitoring_summary(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    report = monitoring.psi_report(*sides, DRIFT_COLUMNS)
    score = report.where("name = 'score'").first()["psi"]
    return monitoring.monitoring_summary(report, score, *sides, "loans", L.EVENT, "rules")


@query("score_summary", on_split(", b AS (SELECT 'reference' AS side, score FROM train "
                                 "UNION ALL SELECT 'production', score FROM test) "
                                 "SELECT side, round(avg(score), 6) AS mean, "
                                 "round(quantile_cont(score, 0.5e0), 6) AS median, "
                                 "round(quantile_cont(score, 0.75e0), 6) AS p75, "
                                 "round(quantile_cont(score, 0.9e0), 6) AS p90, "
                                 "round(quantile_cont(score, 0.95e0), 6) AS p95 FROM b GROUP BY side"))
def score_summary(spark, sf_dir):
    return monitoring.score_summary(*_sides(spark, sf_dir), "score")


def perf_sql(source: str, window: str, score: str = "score", actual: str = "event", t: float = THRESHOLD) -> str:
    return f"""
, wr AS (SELECT {window} AS "window", {score} AS s, {actual} AS a FROM {source})
, wa AS (SELECT "window", count(*) AS n, avg(s) AS score_mean, stddev_samp(s) AS score_std,
    avg(CAST(coalesce(s >= {t}, false) AS DOUBLE)) AS pct_pred_event, count(a) AS n_labeled, avg(a) AS event_rate_real,
    count(*) FILTER (s >= {t} AND a = 1) AS tp, count(*) FILTER (s >= {t} AND a = 0) AS fp,
    count(*) FILTER (NOT s >= {t} AND a = 1) AS fn, count(*) FILTER (NOT s >= {t} AND a = 0) AS tn
  FROM wr GROUP BY "window")
, {curve_ctes('wr', 's', '"window"', 'wc', 'a')}
, wu AS (SELECT "window", CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN {AUC} END AS auc,
                CASE WHEN any_value(p) > 0 THEN {AP} END AS ap FROM wc GROUP BY "window")
, perf AS (SELECT wa."window", wa.n, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std,
    round(pct_pred_event, 6) AS pct_pred_event, n_labeled, round(event_rate_real, 6) AS event_rate_real,
    tp, fp, fn, tn, round(tp / greatest(tp + fn, 1), 6) AS recall_event,
    round(tp / greatest(tp + fp, 1), 6) AS precision_event, round(auc, 6) AS roc_auc
  FROM wa LEFT JOIN wu ON wa."window" = wu."window")"""


MONTH_SQL = "coalesce(strftime(disbursed_at, '%Y-%m'), 'unknown')"


@query("perf_by_month", on_loans(perf_sql("lv", MONTH_SQL) + " SELECT * FROM perf"))
def perf_by_month(spark, sf_dir):
    rows = L.loans(spark, sf_dir).withColumn("window", monitoring.month_window(F.col(L.DATE)))
    return monitoring.performance_by_window(rows, "window", "score", L.EVENT, THRESHOLD)


@query("perf_by_quartile", on_loans(
    ", rn AS (SELECT *, row_number() OVER (ORDER BY loan_id) - 1 AS pos, count(*) OVER () AS nn FROM lv)"
    + perf_sql("rn", "'Q' || CAST(greatest(1, CAST(ceil(4e0 * pos / (nn - 1)) AS BIGINT)) AS VARCHAR)")
    + " SELECT * FROM perf"))
def perf_by_quartile(spark, sf_dir):
    rows = monitoring.position_quarters(L.loans(spark, sf_dir), L.KEY)
    return monitoring.performance_by_window(rows, "window", "score", L.EVENT, THRESHOLD)


# Scoring -------------------------------------------------------------------------------------

VERSION = "rules-1"
SCORED_AT = "2001-12-31"
PREDICTIONS_SQL = f"""SELECT loan_id, sha256(CAST(loan_id AS VARCHAR) || '|{VERSION}') AS prediction_id,
  round(rscore, 6) AS score_event, CAST(rscore >= {THRESHOLD}e0 AS BIGINT) AS pred_event,
  CASE WHEN rscore < {THRESHOLD}e0 * 0.5e0 THEN 'Bajo' WHEN rscore < {THRESHOLD}e0 THEN 'Medio' ELSE 'Alto' END
    AS risk_level FROM rl"""


def score_rules(df, features=()):
    """Row-wise scoring with the rule model, the same in batch and stream; ``features`` stay beside the score."""
    share = rules.rule_columns(df, L.RULES, L.MIN_SIGNALS)["score"]
    columns = scoring.prediction_columns(
        share, F.col(L.KEY), L.EVENT, THRESHOLD, VERSION, F.lit(SCORED_AT).cast("timestamp_ntz"))
    return df.select(L.KEY, L.DATE, *features, *[c.alias(n) for n, c in columns.items()])


def _shown(df):
    return df.drop(L.DATE, "predicted_at")


@query("batch_predictions", on_loans(f", {RULE_SQL} {PREDICTIONS_SQL}"))
def batch_predictions(spark, sf_dir):
    return _shown(score_rules(L.loans(spark, sf_dir)))


@query("prediction_log", on_loans(f""", {RULE_SQL}
SELECT {MONTH_SQL} AS month, count(*) AS n, round(sum(rscore), 4) AS score_sum, round(sum(principal), 4) AS principal_sum,
       count(bureau_income) AS incomes FROM rl GROUP BY 1"""), digits=4)
def prediction_log(spark, sf_dir):
    """Two batches appended with their features to the month-partitioned log, then read back."""
    train, test = _sides(spark, sf_dir)
    undated = L.loans(spark, sf_dir).where(F.col(L.DATE).isNull())
    path = work_path(spark, "log")
    names = event_names(L.EVENT)
    for batch in (train, test.unionByName(undated)):
        sinks.append_predictions(score_rules(batch, [*L.NUMBERS, *L.CATEGORIES]), path, L.DATE)
    # The log keeps six digits; the sum is restored from the number of active rules behind them.
    share = F.round(F.col(names["score_col"]) * len(L.RULES)) / len(L.RULES)
    return spark.read.parquet(path).groupBy(F.col(sinks.MONTH).cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(share).alias("score_sum"), F.sum("principal").alias("principal_sum"),
        F.count("bureau_income").alias("incomes"))


# Streams -------------------------------------------------------------------------------------

@query("stream_score", on_loans(f", {RULE_SQL} {PREDICTIONS_SQL}"))
def stream_score(spark, sf_dir):
    path = L.loans_path(spark, sf_dir)
    sink, checkpoint = streams.fresh_paths(spark, "stream-score")
    return _shown(streams.stream_scores(spark, path, spark.read.parquet(path).schema, score_rules, sink, checkpoint))


EVENTS = "ev AS (SELECT ts, value / 500e0 AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS actual FROM events)"
TEN_DAYS = ("strftime(TIMESTAMP '1970-01-01' + to_days(CAST(floor(epoch(ts) / 864000) * 10 AS INTEGER)), '%Y-%m-%d')")


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    rows = streams.read_files(spark, path, spark.read.parquet(path).schema)
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / F.lit(500.0)).alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("actual"))


@query("stream_monitor", f"WITH {EVENTS}" + perf_sql("ev", TEN_DAYS, "score", "actual", 0.5)
       + ' SELECT * EXCLUDE (roc_auc, "window"), "window" AS window_start FROM perf')
def stream_monitor(spark, sf_dir):
    result = streams.windowed_performance(_event_stream(spark, sf_dir), "ts", "score", "actual", 0.5)
    target, checkpoint = streams.fresh_paths(spark, "stream-monitor")
    return streams.run_updates(result, ["window_start"], checkpoint, target)


@query("stream_areas", f"""WITH {EVENTS}
, wr AS (SELECT {TEN_DAYS} AS window_start, score AS s, actual AS a FROM ev)
, {curve_ctes('wr', 's', 'window_start', 'wc', 'a')}
SELECT window_start, round({AUC}, 6) AS roc_auc, round({AP}, 6) AS avg_precision FROM wc GROUP BY window_start""")
def stream_areas(spark, sf_dir):
    counts = streams.windowed_score_counts(_event_stream(spark, sf_dir), "ts", "score", "actual", digits=None)
    target, checkpoint = streams.fresh_paths(spark, "stream-areas")
    return streams.window_areas(streams.run_updates(counts, ["window_start", "score"], checkpoint, target))


@query("stream_months", f"WITH {EVENTS}" + perf_sql("ev", "strftime(ts, '%Y-%m')", "score", "actual", 0.5)
       + " SELECT * EXCLUDE (roc_auc) FROM perf")
def stream_months(spark, sf_dir):
    result = streams.calendar_month_performance(_event_stream(spark, sf_dir), "ts", "score", "actual", 0.5)
    target, checkpoint = streams.fresh_paths(spark, "stream-months")
    return streams.run_updates(result, ["window"], checkpoint, target)


@query("stream_ingest", on_loans(f"""
, arriving AS ({L.ARRIVALS})
, due AS (SELECT loan_id, disbursed_at FROM arriving WHERE disbursed_at >= TIMESTAMP '1998-03-10')
, once AS (SELECT loan_id, min(disbursed_at) AS disbursed_at FROM due WHERE loan_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT loan_id, disbursed_at FROM due WHERE loan_id IS NULL)
SELECT strftime(disbursed_at, '%Y-%m') AS month, count(*) AS n, CAST(coalesce(sum(loan_id), 0) AS BIGINT) AS ids
FROM once GROUP BY 1"""))
def stream_ingest(spark, sf_dir):
    """Rows without a key are all kept, a key of two months is stored with its earlier row."""
    arriving = L.arrivals(spark, sf_dir).drop("again")
    source = work_path(spark, "arriving")
    arriving.write.parquet(source)
    sink, checkpoint = streams.fresh_paths(spark, "stream-ingest")
    rows = streams.stream_ingest(spark, source, arriving.schema, L.KEY, L.DATE, "1998-3-10", sink, checkpoint)
    return rows.groupBy(month_key(F.col(L.DATE)).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(L.KEY), F.lit(0)).alias("ids"))


@query("quarters_wide_key", on_loans("""
, k AS (SELECT event, row_number() OVER (ORDER BY loan_id) - 1 AS p, count(*) OVER () AS n FROM lv)
SELECT 'Q' || greatest(1, CAST(ceil(4 * p / (n - 1e0)) AS BIGINT)) AS "window", count(*) AS n, CAST(sum(event) AS BIGINT) AS events
FROM k GROUP BY 1"""))
def quarters_wide_key(spark, sf_dir):
    """Position quarters by a 64-bit key of which a double cannot tell neighbours apart."""
    rows = L.loans(spark, sf_dir).select((F.col(L.KEY) + F.lit(1 << 62)).alias("wide"), L.EVENT)
    return monitoring.position_quarters(rows, "wide").groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.sum(L.EVENT).alias("events"))
