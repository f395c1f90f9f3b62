"""Ingestion, stateless and fitted features, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions import expressions as E
from lendscope.operators import features, fitted, splits
from lendscope.operators.wide import filled_slots
from lendscope.plans import loans as L
from lendscope.plans.registry import case_bucket, hash_sql, on_loans, on_split, query, union_all
from lendscope.sources import arrow_files, ingest, readers, sinks, versions
from lendscope.sources.workspace import work_path

LOAN_COLUMNS = ["loan_id", "disbursed_at", "credit_type", "employment", "age", "principal", "term_months",
                "other_loans", "installment", "bureau_income", "bureau_score", "active_loans", "inquiries",
                "income_trend", "behaviour_score", "arrears_balance", "paid_on_time", "score"]


# Ingestion -----------------------------------------------------------------------------------

@query("ingest_since", on_loans("""
SELECT loan_id, credit_type, round(principal, 6) AS principal FROM loans
WHERE disbursed_at >= TIMESTAMP '2000-01-01 00:00:00'"""))
def ingest_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = ingest.since_value("2000-01-03", None, None, lookback_days=2)
    source = {"type": "parquet", "path": L.loans_path(spark, sf_dir)}
    where = ingest.incremental_filter(spark.read.parquet(source["path"]), since, L.DATE)
    return readers.fetch(spark, source, ["loan_id", "credit_type", "principal"], where)


@query("quality_gate", on_loans(", n AS (SELECT count(*) AS r FROM loans)\n" + union_all(
    "SELECT '{c}' AS name, (SELECT r FROM n) AS rows, count(*) - count({c}) AS nulls, "
    "round((count(*) - count({c})) / (SELECT r FROM n), 6) AS null_share FROM loans", LOAN_COLUMNS)))
def quality_gate(spark, sf_dir):
    return ingest.quality_counts(spark.read.parquet(L.loans_path(spark, sf_dir)))


@query("arrow_since", on_loans("""
 SELECT loan_id, disbursed_at, employment FROM loans WHERE disbursed_at >= TIMESTAMP '1999-06-10'"""))
def arrow_since(spark, sf_dir):
    """All loans written as Arrow files; the incremental filter is applied by the source itself."""
    path = work_path(spark, "arrow")
    rows = L.loans(spark, sf_dir).select(L.KEY, L.DATE, "employment")
    arrow_files.write_arrow(rows, path)
    df = readers.open_source(spark, {"type": "arrow", "path": path, "schema": rows.schema})
    return df.where(ingest.incremental_filter(df, "1999-6-10", L.DATE))


@query("duplicate_keys", "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def duplicate_keys(spark, sf_dir):
    return ingest.duplicate_keys(L.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("high_water", on_loans(
    " SELECT CAST(max(disbursed_at) AS VARCHAR) AS last_max_incremental_value FROM loans"))
def high_water(spark, sf_dir):
    return ingest.high_water(L.loans(spark, sf_dir), L.DATE)


RAW_MERGE = on_loans(f"""
, arriving AS ({L.ARRIVALS})
, once AS (SELECT loan_id, disbursed_at FROM arriving WHERE NOT again OR loan_id IS NULL)
SELECT coalesce(strftime(disbursed_at, '%Y-%m'), 'unknown') AS month, count(*) AS n,
       CAST(coalesce(sum(loan_id), 0) AS BIGINT) AS ids FROM once GROUP BY 1""")


@query("raw_merge", RAW_MERGE)
def raw_merge(spark, sf_dir):
    """First load up to a mid-month date, then an overlapping slice with an unpadded cut-off: nothing lost, nothing twice.

    Some rows have no key, and some keys come again a month later.
    """
    rows = L.arrivals(spark, sf_dir).drop("again")
    path = work_path(spark, "raw")
    early = rows.where((F.col(L.DATE) < F.lit("1999-06-20").cast("timestamp_ntz")) | F.col(L.DATE).isNull())
    sinks.merge_slice(early, path, L.DATE, None, unique_key=L.KEY)
    since = "1999-6-10"
    late = rows.where(ingest.incremental_filter(rows, since, L.DATE))
    sinks.merge_slice(late, path, L.DATE, since, unique_key=L.KEY)
    return _by_month(spark.read.parquet(path))


@query("raw_merge_published", RAW_MERGE)
def raw_merge_published(spark, sf_dir):
    """The same two slices, each published as a whole, with rows of a run that failed before its publication between them."""
    rows = L.arrivals(spark, sf_dir).drop("again")
    root = work_path(spark, "published")
    early = rows.where((F.col(L.DATE) < F.lit("1999-06-20").cast("timestamp_ntz")) | F.col(L.DATE).isNull())
    sinks.merge_published(early, root, L.DATE, None, unique_key=L.KEY)
    rows.write.parquet(f"{root}/{versions.new_folder()}/{sinks.MONTH}=1999-06")
    since = "1999-6-10"
    late = rows.where(ingest.incremental_filter(rows, since, L.DATE))
    sinks.merge_published(late, root, L.DATE, since, unique_key=L.KEY)
    return _by_month(sinks.read_published(spark, root, rows.schema))


def _by_month(stored: DataFrame) -> DataFrame:
    return stored.groupBy(F.col(sinks.MONTH).cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("loan_id"), F.lit(0)).alias("ids"))


@query("text_dates", on_loans("""
, f AS (SELECT loan_id, CASE WHEN loan_id % 7 <> 0 THEN disbursed_at END AS ts FROM loans)
SELECT loan_id, CAST(year(ts) AS BIGINT) AS loan_year, CAST(month(ts) AS BIGINT) AS loan_month,
       CASE WHEN ts < TIMESTAMP '2000-10-01' THEN 'train' ELSE 'test' END AS part
FROM f WHERE ts IS NOT NULL"""))
def text_dates(spark, sf_dir):
    """Dates as text, every seventh unreadable: parsed inside the derived features and the split."""
    text = F.when(F.col(L.KEY) % 7 == 0, "bad").otherwise(F.date_format(L.DATE, "yyyy-MM-dd HH:mm:ss"))
    rows = features.stateless(L.loans(spark, sf_dir).withColumn(L.DATE, text), L.CONFIG)
    train, test = splits.temporal_split(rows, L.DATE, L.CUTOFF)
    pick = lambda df, part: df.select(L.KEY, "loan_year", "loan_month", F.lit(part).alias("part"))
    return pick(train, "train").unionByName(pick(test, "test"))


@query("split_text_key", on_loans(f"""
, k AS (SELECT event, CAST('0x' || substr(md5('L-' || loan_id), 1, 15) AS BIGINT) AS num FROM lv)
, h AS (SELECT *, {hash_sql('num', '42')} AS hash FROM k)
, r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY hash, num) AS place, count(*) OVER (PARTITION BY event) AS n FROM h)
SELECT CAST(event AS BIGINT) AS event, CASE WHEN place > round(n * 0.2e0) THEN 'train' ELSE 'test' END AS part, count(*) AS n
FROM r GROUP BY ALL"""))
def split_text_key(spark, sf_dir):
    """Stratified split on a key that is text."""
    rows = L.loans(spark, sf_dir).select(F.concat(F.lit("L-"), L.KEY).alias("ref"), L.EVENT)
    parts = splits.stratified_split(rows, "ref", L.EVENT)
    both = parts[0].withColumn("part", F.lit("train")).unionByName(parts[1].withColumn("part", F.lit("test")))
    return both.groupBy(L.EVENT, "part").agg(F.count(F.lit(1)).alias("n"))


# Stateless features --------------------------------------------------------------------------

RATIO_SQL = """
  other_loans / nullif(principal, 0) AS debt_to_principal,
  bureau_income / nullif(installment, 0) AS income_cover,
  (principal + other_loans) / nullif(bureau_income, 0) AS burden,
  bureau_score / (inquiries + 2e0) AS score_per_inquiry"""
RATIO_NAMES = [r["name"] for r in L.RATIOS]


@query("ratio_features", on_loans(
    f", f AS (SELECT loan_id, {RATIO_SQL} FROM loans)\n SELECT loan_id, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in RATIO_NAMES) + " FROM f"))
def ratio_features(spark, sf_dir):
    return features.ratio_features(L.loans(spark, sf_dir), L.RATIOS).select(L.KEY, *RATIO_NAMES)


@query("sum_pct", on_loans("""
, f AS (SELECT loan_id, principal + other_loans + installment AS total_debt, principal FROM loans)
SELECT loan_id, round(total_debt, 6) AS total_debt, round(principal / nullif(total_debt, 0), 6) AS principal_share
FROM f"""))
def sum_pct(spark, sf_dir):
    spec = {
        "sums": [{"name": "total_debt", "cols": ["principal", "other_loans", "installment"]}],
        "shares": [{"name": "principal_share", "numerator": "principal", "denominator": "total_debt"}],
    }
    return features.derive(L.loans(spark, sf_dir), spec).select(L.KEY, "total_debt", "principal_share")


@query("date_parts", on_loans("""
SELECT loan_id, CAST(year(disbursed_at) AS BIGINT) AS loan_year, CAST(month(disbursed_at) AS BIGINT) AS loan_month,
       dayname(disbursed_at) AS loan_weekday FROM loans"""))
def date_parts(spark, sf_dir):
    out = features.date_features(L.loans(spark, sf_dir), L.DATE, L.CONFIG["derived"]["dates"])
    return out.select(L.KEY, "loan_year", "loan_month", "loan_weekday")


@query("loan_age_days", on_loans(f"""
SELECT loan_id, CAST(floor(date_diff('microsecond', disbursed_at, TIMESTAMP '{L.REFERENCE_DATE}') / 86400000000e0)
       AS BIGINT) AS loan_age_days FROM loans"""))
def loan_age_days(spark, sf_dir):
    out = features.date_features(L.loans(spark, sf_dir), L.DATE, L.CONFIG["derived"]["dates"])
    return out.select(L.KEY, "loan_age_days")


AGE_SQL = case_bucket("age", L.AGE_BINS, L.AGE_LABELS)
BUREAU_SQL = case_bucket("bureau_score", L.SCORE_BINS, L.SCORE_LABELS)


@query("buckets", on_loans(f"""
SELECT loan_id, {AGE_SQL} AS age_bucket, {BUREAU_SQL} AS score_bucket FROM loans"""))
def buckets(spark, sf_dir):
    out = features.bucket_features(L.loans(spark, sf_dir), L.CONFIG["derived"]["buckets"])
    return out.select(L.KEY, "age_bucket", "score_bucket")


@query("clean_trend", on_loans("""
SELECT loan_id, CASE WHEN income_trend IN ('down', 'flat', 'up') THEN income_trend END AS income_trend FROM loans"""))
def clean_trend(spark, sf_dir):
    return features.clean_categories(L.loans(spark, sf_dir), L.CONFIG["catalogues"]).select(L.KEY, "income_trend")


@query("event_label", on_loans(" SELECT loan_id, CAST(event AS BIGINT) AS event FROM lv"))
def event_label(spark, sf_dir):
    return L.loans(spark, sf_dir).select(L.KEY, L.EVENT)


@query("risk_band", on_loans("""
SELECT loan_id, CAST(score >= 0.6 AS BIGINT) AS pred,
       CASE WHEN score < 0.6e0 * 0.5e0 THEN 'Bajo' WHEN score < 0.6e0 THEN 'Medio' ELSE 'Alto' END AS risk_level
FROM loans"""))
def risk_band(spark, sf_dir):
    score = F.col("score")
    return L.loans(spark, sf_dir).select(
        L.KEY, E.decision(score, 0.6).alias("pred"), E.risk_band(score, 0.6).alias("risk_level"))


@query("parse_dates", on_loans("""
SELECT loan_id, strftime(disbursed_at, '%Y-%m-%d') AS day FROM loans WHERE disbursed_at IS NOT NULL
UNION ALL SELECT loan_id, NULL AS day FROM loans WHERE disbursed_at IS NULL"""))
def parse_dates(spark, sf_dir):
    """Dates as text, missing ones written as words, read back; unreadable text becomes null."""
    text = F.coalesce(F.date_format(L.DATE, "yyyy-MM-dd HH:mm:ss"), F.lit("not a date"))
    return L.loans(spark, sf_dir).select(L.KEY, F.date_format(E.parse_timestamp(text), "yyyy-MM-dd").alias("day"))


# Fitted features -----------------------------------------------------------------------------

def _train(spark, sf_dir):
    rows = L.loans(spark, sf_dir)
    return rows, splits.temporal_split(rows, L.DATE, L.CUTOFF)[0]


IMPUTE_CTE = """
med AS (SELECT employment, quantile_cont(bureau_income, 0.5) AS m FROM train
        WHERE employment IS NOT NULL GROUP BY employment),
gmed AS (SELECT quantile_cont(bureau_income, 0.5) AS m FROM train)"""
def _caps(source: str) -> str:
    return "cap AS (SELECT " + ", ".join(
        f"quantile_cont({c}, {L.CONFIG['cap_quantile']!r}e0) AS c_{c}" for c in L.CONFIG["cap_columns"]) + f" FROM {source})"


CAP_CTE = _caps("train")
CAPPED = ", ".join(f"CASE WHEN {c} > (SELECT c_{c} FROM cap) THEN (SELECT c_{c} FROM cap) ELSE {c} END AS {c}"
                   for c in L.CONFIG["cap_columns"])
ROUNDED_CAPS = ", ".join(f"round({c}, 6) AS {c}" for c in L.CONFIG["cap_columns"])


@query("impute_segmented", on_split(f""", {IMPUTE_CTE}
SELECT loan_id, round(coalesce(bureau_income, med.m, (SELECT m FROM gmed)), 6) AS bureau_income
FROM lv LEFT JOIN med ON lv.employment = med.employment"""))
def impute_segmented(spark, sf_dir):
    rows, train = _train(spark, sf_dir)
    params = fitted.fit_segment_medians(train, L.CONFIG["impute"])
    return fitted.apply_segment_medians(rows, params, L.CONFIG["impute"]).select(L.KEY, "bureau_income")


@query("winsorise", on_split(f""", {CAP_CTE}
, c AS (SELECT loan_id, {CAPPED} FROM lv)
SELECT loan_id, {ROUNDED_CAPS} FROM c"""))
def winsorise(spark, sf_dir):
    rows, train = _train(spark, sf_dir)
    params = fitted.fit_caps(train, L.CONFIG["cap_columns"], L.CONFIG["cap_quantile"])
    return fitted.apply_caps(rows, params).select(L.KEY, *L.CONFIG["cap_columns"])


def _scaled(cols) -> str:
    return ", ".join(f"(coalesce({c}, m_{c}) - a_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END) AS numeric__{c}"
                     for c in cols)


def _scale_ctes(cols, source: str) -> str:
    medians = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in cols)
    stats = ", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in cols)
    return f"fillv AS (SELECT {medians} FROM {source}), scalev AS (SELECT {stats} FROM {source}, fillv)"


SCALE_COLS = ["inquiries", "term_months", "bureau_income", "other_loans"]


@query("scale_numeric", on_split(f""", {_scale_ctes(SCALE_COLS, 'train')}
, z AS (SELECT loan_id, {_scaled(SCALE_COLS)} FROM lv, fillv, scalev)
SELECT loan_id, {', '.join(f'round(numeric__{c}, 6) AS numeric__{c}' for c in SCALE_COLS)} FROM z"""))
def scale_numeric(spark, sf_dir):
    rows, train = _train(spark, sf_dir)
    params = fitted.fit_encoder(train, SCALE_COLS, [], {})
    return fitted.apply_encoder(rows, params, {"numeric": SCALE_COLS, "nominal": [], "ordinal": {}}, [L.KEY])


# The categories of the order tables, sorted; the first of each is left out.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _dummies(alias: str = "") -> str:
    out = []
    for col, values in (("credit_type", PRIORITIES), ("employment", SEGMENTS)):
        for v in values[1:]:
            out.append(f"CAST(coalesce({alias}{col}, (SELECT m_{col} FROM modev)) = '{v}' AS DOUBLE)"
                       f' AS "categoric__{col}_{v}"')
    return ", ".join(out)


MODE_CTE = "modev AS (SELECT " + ", ".join(
    f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}"
    for c in L.CATEGORIES) + ")"


@query("wide_one_hot", """
WITH k AS (SELECT CAST(l_partkey AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () - 1 AS size FROM k)
SELECT l_orderkey, l_linenumber, size, nullif(place, 0) - 1 AS slot
FROM lineitem JOIN p ON key = CAST(l_partkey AS VARCHAR)""")
def wide_one_hot(spark, sf_dir):
    """A column of thousands of categories as a sparse vector, the others of its table as columns."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    params = fitted.fit_encoder(rows, [], ["l_partkey", "l_linestatus"], {}, most=100)
    config = {"numeric": [], "nominal": ["l_partkey", "l_linestatus"], "ordinal": {}}
    coded = fitted.apply_encoder(rows, params, config, ["l_orderkey", "l_linenumber"])
    slots = filled_slots("categoric__l_partkey")
    return coded.select("l_orderkey", "l_linenumber", slots["size"].alias("size"), F.get(slots["indices"], F.lit(0)).alias("slot"))


@query("one_hot", on_split(f", {MODE_CTE}\n SELECT loan_id, {_dummies()} FROM lv"))
def one_hot(spark, sf_dir):
    rows, train = _train(spark, sf_dir)
    params = fitted.fit_encoder(train, [], L.CATEGORIES, {})
    return fitted.apply_encoder(rows, params, {"numeric": [], "nominal": L.CATEGORIES, "ordinal": {}}, [L.KEY])


def _mode(expr: str, name: str) -> str:
    return (f"(SELECT v FROM (SELECT {expr} AS v FROM train) WHERE v IS NOT NULL GROUP BY v "
            f"ORDER BY count(*) DESC, v LIMIT 1) AS m_{name}")


TREND_SQL = "CASE WHEN income_trend IN ('down', 'flat', 'up') THEN income_trend END"
ORDINALS = [("income_trend", TREND_SQL, L.TRENDS), ("age_bucket", AGE_SQL, L.AGE_LABELS),
            ("score_bucket", BUREAU_SQL, L.SCORE_LABELS)]
ORD_CTE = "ordv AS (SELECT " + ", ".join(_mode(expr, name) for name, expr, _ in ORDINALS) + ")"


def _positions() -> str:
    return ", ".join(
        f"CAST(coalesce(list_position({levels!r}, coalesce({expr}, (SELECT m_{name} FROM ordv))) - 1, -1) AS DOUBLE)"
        f" AS cat_ord__{name}" for name, expr, levels in ORDINALS)


@query("ordinal", on_split(f", {ORD_CTE}\n SELECT loan_id, {_positions()} FROM lv"))
def ordinal(spark, sf_dir):
    rows, train = _train(spark, sf_dir)
    ready = lambda d: features.stateless(d, L.CONFIG)
    params = fitted.fit_encoder(ready(train), [], [], L.CONFIG["ordinal"])
    config = {"numeric": [], "nominal": [], "ordinal": L.CONFIG["ordinal"]}
    return fitted.apply_encoder(ready(rows), params, config, [L.KEY])


NUMERIC = L.CONFIG["numeric"]
_kept = [c for c in NUMERIC if c not in RATIO_NAMES + L.CONFIG["cap_columns"] + ["bureau_income"]]
BASE_COLS = f"""loan_id, event, disbursed_at, credit_type, lv.employment, income_trend, age, bureau_score,
  {', '.join(_kept)},
  {RATIO_SQL},
  coalesce(bureau_income, med.m, (SELECT m FROM gmed)) AS bureau_income, {CAPPED}"""


@query("feature_matrix", on_split(f""", {IMPUTE_CTE}, {CAP_CTE}, {MODE_CTE}, {ORD_CTE},
whole AS (SELECT {BASE_COLS} FROM lv LEFT JOIN med ON lv.employment = med.employment
          WHERE disbursed_at IS NOT NULL),
basetrain AS (SELECT * FROM whole WHERE disbursed_at < TIMESTAMP '{L.AFTER_CUTOFF}'),
{_scale_ctes(NUMERIC, 'basetrain')},
z AS (SELECT loan_id, event, CASE WHEN disbursed_at < TIMESTAMP '{L.AFTER_CUTOFF}' THEN 'train' ELSE 'test' END AS split,
             {_scaled(NUMERIC)}, {_dummies('whole.')}, {_positions()} FROM whole, fillv, scalev)
SELECT * REPLACE ({', '.join(f'round(numeric__{c}, 5) AS numeric__{c}' for c in NUMERIC)},
                  CAST(event AS BIGINT) AS event) FROM z"""), digits=5)
def feature_matrix(spark, sf_dir):
    """The whole feature build: stateless, split, fitted on train, encoded, both splits."""
    parts = fitted.build_features(L.loans(spark, sf_dir), L.CONFIG, L.EVENT, [L.KEY])
    sides = [parts[s].withColumn("split", F.lit(s)) for s in ("train", "test")]
    return reduce(DataFrame.unionByName, sides)


@query("feature_tables", on_split("""
SELECT 'train' AS part, count(*) AS n, CAST(sum(loan_id) AS BIGINT) AS ids FROM train
UNION ALL SELECT 'test', count(*), CAST(sum(loan_id) AS BIGINT) FROM test"""))
def feature_tables(spark, sf_dir):
    """Feature tables written, read back through the cache reader, and counted."""
    parts = fitted.build_features(L.loans(spark, sf_dir), L.CONFIG, L.EVENT, [L.KEY])
    folder = work_path(spark, "features")
    sinks.write_features(parts, folder)
    cached = sinks.read_features(spark, folder)
    sides = [cached[s].select(F.lit(s).alias("part"), L.KEY) for s in ("train", "test")]
    return reduce(DataFrame.unionByName, sides).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(L.KEY).alias("ids"))


@query("combined_features", on_loans(f"""
, gmed AS (SELECT quantile_cont(bureau_income, 0.5) AS m FROM lv)
, med AS (SELECT employment, quantile_cont(bureau_income, 0.5) AS m FROM lv
          WHERE employment IS NOT NULL GROUP BY employment)
, {_caps("lv")}
, c AS (SELECT loan_id, coalesce(bureau_income, med.m, (SELECT m FROM gmed)) AS bureau_income, {CAPPED}
        FROM lv LEFT JOIN med ON lv.employment = med.employment)
SELECT loan_id, round(bureau_income, 6) AS bureau_income, {ROUNDED_CAPS} FROM c"""))
def combined_features(spark, sf_dir):
    base, _ = fitted.fit_combined(L.loans(spark, sf_dir), L.CONFIG)
    return base.select(L.KEY, "bureau_income", *L.CONFIG["cap_columns"])


# Splits --------------------------------------------------------------------------------------

@query("split_temporal", on_split("""
, s AS (SELECT 'train' AS split, event FROM train UNION ALL SELECT 'test', event FROM test)
SELECT split, count(*) AS n, round(avg(event), 6) AS event_rate,
       round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY split"""))
def split_temporal(spark, sf_dir):
    train, test = splits.split_frame(L.loans(spark, sf_dir), L.CONFIG["split"], L.EVENT)
    return splits.split_report({"train": train, "test": test}, L.EVENT)


@query("split_random", on_loans(f"""
, h AS (SELECT loan_id, event, row_number() OVER (PARTITION BY event ORDER BY {hash_sql('loan_id', '42')}, loan_id) AS r,
               count(*) OVER (PARTITION BY event) AS n FROM lv)
SELECT loan_id, CASE WHEN r <= round(n * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM h"""))
def split_random(spark, sf_dir):
    spec = {"type": "random", "key": L.KEY, "test_size": 0.2, "random_state": 42}
    train, test = splits.split_frame(L.loans(spark, sf_dir), spec, L.EVENT)
    side = lambda d, s: d.select(L.KEY, F.lit(s).alias("split"))
    return side(train, "train").unionByName(side(test, "test"))


def _fold_sql(k: int) -> str:
    """Fold of 1-based position ``r`` among ``n`` rows, the first ``n mod k`` folds one row longer."""
    return (f"CAST(CASE WHEN r - 1 < (n % {k}) * (n // {k} + 1) THEN (r - 1) // (n // {k} + 1) "
            f"ELSE (n % {k}) + (r - 1 - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) END AS BIGINT)")


@query("folds_strat", on_loans(f"""
, h AS (SELECT loan_id, row_number() OVER (PARTITION BY event ORDER BY {hash_sql('loan_id', '42')}, loan_id) AS r,
               count(*) OVER (PARTITION BY event) AS n FROM lv)
SELECT loan_id, {_fold_sql(5)} AS fold FROM h"""))
def folds_strat(spark, sf_dir):
    return splits.folds(L.loans(spark, sf_dir), L.KEY, 5, [L.EVENT]).select(L.KEY, "fold")


@query("folds_plain", on_loans(f"""
, h AS (SELECT loan_id, row_number() OVER (ORDER BY {hash_sql('loan_id', '42')}, loan_id) AS r,
               count(*) OVER () AS n FROM lv)
SELECT loan_id, {_fold_sql(10)} AS fold FROM h"""))
def folds_plain(spark, sf_dir):
    return splits.folds(L.loans(spark, sf_dir), L.KEY, 10).select(L.KEY, "fold")


SIZES = [0.1, 0.325, 0.55, 0.775, 1.0]


def shuffle_cte(source: str, repeats: int) -> str:
    cuts = " ".join(f"WHEN r <= t + floor((n - t) * {s}e0) THEN {i}" for i, s in enumerate(SIZES[:-1], 1))
    return f"""h AS (
  SELECT s.*, rep.repeat, row_number() OVER (PARTITION BY rep.repeat
           ORDER BY {hash_sql('loan_id', '42 + rep.repeat')}, loan_id) AS r,
         count(*) OVER (PARTITION BY rep.repeat) AS n
  FROM {source} s, (SELECT unnest(range(1, {repeats + 1})) AS repeat) rep),
shuffled AS (SELECT *, CASE WHEN r <= t THEN 0 {cuts} ELSE {len(SIZES)} END AS part
             FROM (SELECT *, ceil(n * 0.2e0) AS t FROM h))"""


@query("shuffle_sizes", on_loans(f""", {shuffle_cte('lv', 3)}
SELECT CAST(repeat AS BIGINT) AS repeat, loan_id, CAST(part AS BIGINT) AS part FROM shuffled"""))
def shuffle_sizes(spark, sf_dir):
    rows = L.loans(spark, sf_dir).select(L.KEY)
    return splits.repeated_shuffles(rows, L.KEY, 3, SIZES).select("repeat", L.KEY, "part")
