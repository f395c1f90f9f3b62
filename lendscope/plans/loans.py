"""The loan table rebuilt from the order tables, and the settings the queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lendscope.operators.features import add_event
from lendscope.sources.readers import nan_to_null
from lendscope.sources.workspace import work_path

# The same text defines the table in Spark and in the checking database.
LOAN_CTES = """
li AS (
  SELECT l_orderkey,
         CAST(COUNT(*) AS INT)                                             AS n_lines,
         SUM(l_extendedprice)                                              AS sum_price,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT)  AS n_returned,
         CAST(COUNT(DISTINCT l_suppkey) AS INT)                            AS n_supp
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.*, c.c_mktsegment, c.c_acctbal, li.n_lines, li.sum_price, li.n_returned, li.n_supp,
         CASE WHEN o.o_orderstatus = 'F' AND (o.o_orderkey + COALESCE(li.n_lines, 0)) % 4 = 0
              THEN 1 ELSE 0 END AS ev
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
loans AS (
  SELECT o_orderkey                                                    AS loan_id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END  AS disbursed_at,
         o_orderpriority                                               AS credit_type,
         c_mktsegment                                                  AS employment,
         CAST(o_custkey % 110 AS INT) + 15                             AS age,
         o_totalprice                                                  AS principal,
         COALESCE(n_lines, 0) * 6                                      AS term_months,
         sum_price                                                     AS other_loans,
         o_totalprice / (COALESCE(n_lines, 0) + 1)                     AS installment,
         CASE WHEN o_custkey % 4 = 0 THEN NULL
              WHEN o_custkey % 29 = 1 THEN 0e0 ELSE c_acctbal END      AS bureau_income,
         CASE WHEN o_orderkey % 211 = 0 THEN NULL
              ELSE CAST(1000 - (o_orderkey * 37) % 1015 AS DOUBLE) END AS bureau_score,
         COALESCE(n_returned, 0)                                       AS active_loans,
         COALESCE(n_supp, 0) + 4 * ev                                  AS inquiries,
         CASE o_orderkey % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'flat' WHEN 2 THEN 'down'
              WHEN 3 THEN '1250000' ELSE NULL END                      AS income_trend,
         CASE WHEN ev = 1 THEN CAST(o_orderkey % 90 AS DOUBLE) ELSE 95.23e0 END AS behaviour_score,
         ev * o_totalprice                                             AS arrears_balance,
         1 - ev                                                        AS paid_on_time,
         CAST((o_orderkey * 7919) % 700 + 300 * ev AS DOUBLE) / 1000e0 AS score
  FROM base)
"""

TABLES = ("lineitem", "orders", "customer")
#: Line items are grouped, and customers joined, in one task per so many bytes of all input files.
JOINED_BY, PART_BYTES = {"lineitem": "l_orderkey", "customer": "c_custkey"}, 8 << 20
CUTOFF = "2000-09"
AFTER_CUTOFF = "2000-10-01"
REFERENCE_DATE = "2001-12-31"
EVENT = "event"
KEY = "loan_id"
DATE = "disbursed_at"

# Settings chosen from the loan view itself: bins leave values out on both sides, as ages run from 15 to 124 and
# scores from -14 to 1000; the rules mark roughly a third, a half, a quarter and a fifth of the loans.
AGE_BINS = [20, 40, 60, 80, 100]
AGE_LABELS = [f"{lo} to {hi - 1}" for lo, hi in zip(AGE_BINS, AGE_BINS[1:])]
SCORE_BINS = [0, 250, 500, 750, 1000]
SCORE_LABELS = [f"from {lo}" for lo in SCORE_BINS[:-1]]
TRENDS = ["down", "flat", "up"]

RULES = [
    {"col": "term_months", "op": ">=", "threshold": 30},
    {"col": "bureau_score", "op": "<=", "threshold": 500},
    {"col": "inquiries", "op": ">", "threshold": 6},
    {"col": "age", "op": "<", "threshold": 35},
]
MIN_SIGNALS = 2

NUMBERS = ["active_loans", "age", "bureau_income", "bureau_score", "inquiries", "installment", "other_loans",
           "principal", "term_months"]
CATEGORIES = ["credit_type", "employment"]

RATIOS = [
    {"name": "debt_to_principal", "numerator": "other_loans", "denominator": "principal"},
    {"name": "income_cover", "numerator": "bureau_income", "denominator": "installment"},
    {"name": "burden", "numerator_sum": ["principal", "other_loans"], "denominator": "bureau_income"},
    {"name": "score_per_inquiry", "numerator": "bureau_score", "denominator": "inquiries", "denominator_add": 2},
]

CONFIG = {
    "date_col": DATE,
    "split": {"type": "temporal", "date_col": DATE, "train_cutoff": CUTOFF},
    "derived": {
        "ratios": RATIOS,
        "dates": {"col": DATE, "reference_date": REFERENCE_DATE, "year_col": "loan_year", "month_col": "loan_month",
                  "weekday_col": "loan_weekday", "age_col": "loan_age_days"},
        "buckets": [
            {"name": "age_bucket", "col": "age", "bins": AGE_BINS, "labels": AGE_LABELS},
            {"name": "score_bucket", "col": "bureau_score", "bins": SCORE_BINS, "labels": SCORE_LABELS},
        ],
    },
    "catalogues": {"income_trend": TRENDS},
    "impute": {"bureau_income": "employment"},
    "cap_columns": ["installment", "other_loans"],
    "cap_quantile": 0.99,
    "leakage": ["behaviour_score", "arrears_balance", "paid_on_time"],
    "drop": ["loan_age_days", "loan_year", "loan_month", "loan_weekday", "score"],
    "numeric": [*[c for c in NUMBERS if c not in ("age", "bureau_score")], *[r["name"] for r in RATIOS]],
    "nominal": CATEGORIES,
    "ordinal": {"income_trend": TRENDS, "age_bucket": AGE_LABELS, "score_bucket": SCORE_LABELS},
}

_WRITTEN: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def loans_plan(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    """The loans; with several ``parts`` line items and customers are dealt by the keys of the joins into as many tasks."""
    text = f"WITH {LOAN_CTES} SELECT * FROM loans"
    for name in TABLES:
        view, rows = f"lendscope_{name}", spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (rows.repartition(parts, JOINED_BY[name]) if parts > 1 and name in JOINED_BY else rows).createOrReplaceTempView(view)
        text = text.replace(f"FROM {name} ", f"FROM {view} ").replace(f"JOIN {name} ", f"JOIN {view} ")
    return nan_to_null(spark.sql(text))


def input_state(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Path, size and time of every input file, so that a changed input is noticed."""
    files = None
    for name in TABLES:
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(
            "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = one if files is None else files.unionByName(one)
    return sorted(tuple(r) for r in files.collect())


def loan_parts(spark: SparkSession, files: Sequence[tuple]) -> int:
    """Tasks of the joins, by the input's bytes: what one task holds stays the same however large the tables are."""
    parts = -(-sum(size for _, size, _ in files) // PART_BYTES)
    return max(parts, spark.sparkContext.defaultParallelism) if parts > 1 else 1


def loans_path(spark: SparkSession, sf_dir: str) -> str:
    """The loan table as written once per application to the shared folder.

    Every operator reads it one or more times; written, those reads are plain columnar scans with
    pruned columns instead of repeated joins, and they survive the loss of an executor.
    """
    key = (spark.sparkContext.applicationId, sf_dir, *input_state(spark, sf_dir))
    if key not in _WRITTEN:
        path = work_path(spark, "loans")
        loans_plan(spark, sf_dir, loan_parts(spark, key[2:])).write.parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


# Loans as they could arrive: every 13th without a key, every 17th once more a month later.
ARRIVALS = """SELECT CASE WHEN loan_id % 13 <> 0 THEN loan_id END AS loan_id, disbursed_at, principal, false AS again FROM loans
UNION ALL SELECT CASE WHEN loan_id % 13 <> 0 THEN loan_id END, disbursed_at + INTERVAL 1 MONTH, principal, true
FROM loans WHERE loan_id % 17 = 0"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(loans_path(spark, sf_dir)).createOrReplaceTempView("lendscope_arriving")
    return spark.sql(ARRIVALS.replace("FROM loans", "FROM lendscope_arriving"))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table with the event column."""
    return add_event(spark.read.parquet(loans_path(spark, sf_dir)), "paid_on_time", EVENT)
