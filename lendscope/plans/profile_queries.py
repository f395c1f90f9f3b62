"""Exploratory tables and association measures."""

from __future__ import annotations

from lendscope.functions import constants as K
from lendscope.operators import association, profile
from lendscope.plans import loans as L
from lendscope.plans.registry import bin_sql, on_loans, prob_list, query, union_all

ALL_COLUMNS = ["loan_id", "disbursed_at", "credit_type", "employment", "age", "principal", "term_months",
               "other_loans", "installment", "bureau_income", "bureau_score", "active_loans", "inquiries",
               "income_trend", "behaviour_score", "arrears_balance", "paid_on_time", "score", "event"]
LONG = "long AS (" + union_all(
    "SELECT event, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM lv WHERE {c} IS NOT NULL", L.NUMBERS) + ")"
QUARTS = "quantile_cont(value, 0.25e0) AS q1, quantile_cont(value, 0.5e0) AS q2, quantile_cont(value, 0.75e0) AS q3"
SUMMARY = """count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  round(min(value), 4) AS min, round(max(value), 4) AS max, round(quantile_cont(value, 0.25e0), 4) AS q25,
  round(quantile_cont(value, 0.5e0), 4) AS q50, round(quantile_cont(value, 0.75e0), 4) AS q75"""


@query("null_profile", on_loans(", c AS (" + union_all(
    "SELECT '{c}' AS name, count(*) - count({c}) AS nulls, count(*) AS n FROM lv", ALL_COLUMNS)
    + ") SELECT name, nulls, round(100e0 * nulls / n, 6) AS pct FROM c WHERE nulls > 0"))
def null_profile(spark, sf_dir):
    return profile.null_profile(L.loans(spark, sf_dir))


@query("dup_rows", """SELECT count(*) AS n_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates
FROM lineitem""")
def dup_rows(spark, sf_dir):
    return profile.duplicate_rows(L.table(spark, sf_dir, "lineitem"))


@query("column_summary", on_loans(f", {LONG} SELECT name, {SUMMARY} FROM long GROUP BY name"), digits=4)
def column_summary(spark, sf_dir):
    return profile.column_summary(L.loans(spark, sf_dir), L.NUMBERS)


@query("summary_by_class", on_loans(
    f", {LONG} SELECT CAST(event AS BIGINT) AS event, name, {SUMMARY} FROM long GROUP BY event, name"), digits=4)
def summary_by_class(spark, sf_dir):
    return profile.column_summary(L.loans(spark, sf_dir), L.NUMBERS, [L.EVENT])


@query("category_quality", on_loans("""
SELECT count(*) FILTER (income_trend IN ('down', 'flat', 'up')) AS n_valid,
       count(*) FILTER (income_trend NOT IN ('down', 'flat', 'up')) AS n_dirty,
       count(*) FILTER (income_trend IS NULL) AS n_null FROM loans"""))
def category_quality(spark, sf_dir):
    return profile.category_quality(L.loans(spark, sf_dir), "income_trend", L.TRENDS)


@query("dirty_values", on_loans("""
SELECT income_trend AS value, count(*) AS n FROM loans WHERE income_trend NOT IN ('down', 'flat', 'up')
GROUP BY 1 ORDER BY n DESC, value LIMIT 10"""))
def dirty_values(spark, sf_dir):
    return profile.top_dirty(L.loans(spark, sf_dir), "income_trend", L.TRENDS)


@query("class_balance", on_loans("""
SELECT CAST(paid_on_time AS BIGINT) AS paid_on_time, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM loans), 6) AS share FROM loans GROUP BY 1"""))
def class_balance(spark, sf_dir):
    return profile.class_balance(L.loans(spark, sf_dir), "paid_on_time")


@query("share_at_max", on_loans("""
SELECT round(avg(CAST(coalesce(behaviour_score = (SELECT max(behaviour_score) FROM lv), false) AS DOUBLE)), 6)
       AS share_at_max FROM lv WHERE event = 0"""))
def share_at_max(spark, sf_dir):
    return profile.share_at_max(L.loans(spark, sf_dir), "behaviour_score", L.EVENT)


@query("monthly_rate", on_loans("""
, m AS (SELECT strftime(disbursed_at, '%Y-%m') AS month, count(*) AS n, avg(event) AS event_rate
        FROM lv WHERE disbursed_at IS NOT NULL GROUP BY 1)
SELECT month, n, round(event_rate, 6) AS event_rate,
       round(CASE WHEN count(*) OVER w = 3 THEN avg(event_rate) OVER w END, 6) AS rolling3
FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def monthly_rate(spark, sf_dir):
    return profile.monthly_rate(L.loans(spark, sf_dir), L.DATE, L.EVENT)


@query("weekday_rate", on_loans("""
SELECT CAST(isodow(disbursed_at) AS BIGINT) AS day, dayname(disbursed_at) AS weekday, count(*) AS n,
       round(avg(event), 6) AS event_rate FROM lv WHERE disbursed_at IS NOT NULL GROUP BY 1, 2"""))
def weekday_rate(spark, sf_dir):
    return profile.weekday_rate(L.loans(spark, sf_dir), L.DATE, L.EVENT)


@query("category_frequencies", on_loans(
    " SELECT employment AS value, count(*) AS n FROM loans WHERE employment IS NOT NULL GROUP BY 1"))
def category_frequencies(spark, sf_dir):
    return profile.category_frequencies(L.loans(spark, sf_dir), "employment")


def histogram_sql(group: str, bins: int) -> str:
    """Zero-filled equal-width counts over ``long`` per ``group`` columns."""
    on = " AND ".join(f"x.{c} = s.{c}" for c in group.split(", "))
    pick = ", ".join(f"s.{c}" for c in group.split(", "))
    return f"""
, s0 AS (SELECT {group}, min(value) AS a, max(value) AS b, count(*) AS total FROM long GROUP BY {group})
, s AS (SELECT {group}, total, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo,
               ((CASE WHEN a = b THEN b + 0.5 ELSE b END) - (CASE WHEN a = b THEN a - 0.5 ELSE a END)) / {bins} AS width
        FROM s0)
, g AS (SELECT s.*, unnest(range(0, {bins})) AS bin FROM s)
, x AS (SELECT {pick}, least(len(list_filter(range(1, {bins}), lambda i: value >= lo + i * width)), {bins - 1}) AS bin
        FROM long x JOIN s ON {on})
, c AS (SELECT {group}, bin, count(*) AS n FROM x GROUP BY {group}, bin)
, out AS (SELECT {', '.join(f'g.{c}' for c in group.split(', '))}, g.bin, round(lo + width * g.bin, 4) AS bin_lo,
       round(lo + width * (g.bin + 1), 4) AS bin_hi, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) / (total * width), 4) AS density
  FROM g LEFT JOIN c ON {' AND '.join(f'g.{c} = c.{c}' for c in group.split(', '))} AND g.bin = c.bin)
"""


@query("histogram", on_loans(f", {LONG} {histogram_sql('name', 30)} SELECT * FROM out"), digits=4)
def histogram(spark, sf_dir):
    return profile.histogram(L.loans(spark, sf_dir), L.NUMBERS, 30)


@query("histogram_by_class", on_loans(
    ", long AS (SELECT event, 'behaviour_score' AS name, behaviour_score AS value FROM lv)"
    f" {histogram_sql('event, name', 40)} SELECT * REPLACE (CAST(event AS BIGINT) AS event) FROM out"), digits=4)
def histogram_by_class(spark, sf_dir):
    return profile.histogram(L.loans(spark, sf_dir), ["behaviour_score"], 40, [L.EVENT])


BOX = """
, q AS (SELECT {g}, {quarts} FROM long GROUP BY {g})
, j AS (SELECT long.*, q1, q2, q3, value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS inside
        FROM long JOIN q USING ({g}))
SELECT {g}, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
       round(min(value) FILTER (inside), 4) AS whisker_low, round(max(value) FILTER (inside), 4) AS whisker_high,
       count(*) FILTER (NOT inside) AS n_beyond FROM j GROUP BY {g}, q1, q2, q3"""


@query("box_stats", on_loans(f", {LONG} " + BOX.format(g="name", quarts=QUARTS)), digits=4)
def box_stats(spark, sf_dir):
    return profile.box_stats(L.loans(spark, sf_dir), L.NUMBERS)


@query("box_stats_by_class", on_loans(
    f", {LONG} " + BOX.format(g="event, name", quarts=QUARTS).replace(
        "SELECT event, name, round(q1", "SELECT CAST(event AS BIGINT) AS event, name, round(q1")), digits=4)
def box_stats_by_class(spark, sf_dir):
    return profile.box_stats(L.loans(spark, sf_dir), L.NUMBERS, [L.EVENT])


KDE = """
, s AS (SELECT {g}, min(value) AS lo, max(value) AS hi, count(*) AS total,
               stddev_samp(value) * pow(count(*), -0.2e0) AS h FROM long GROUP BY {g})
, x AS (SELECT long.*, lo, hi, total, h, (hi - lo) / 2048 AS w FROM long JOIN s USING ({g}))
, c AS (SELECT {g}, lo, hi, total, h, w, least(floor((value - lo) / w), 2047) AS cell, count(*) AS n, avg(value) AS m
        FROM x GROUP BY ALL)
, p AS (SELECT c.*, unnest(range(0, 200)) AS point FROM c)
, y AS (SELECT *, lo - 3 * h + (hi - lo + 6 * h) / 199 * point AS x FROM p)
SELECT {out}, point, round(any_value(x), 6) AS x,
       round(sum(n * exp(-0.5e0 * ((x - m) / h) * ((x - m) / h))) / any_value(total * h * sqrt(2 * pi())), 6) AS density
FROM y GROUP BY {g}, point"""


@query("kde", on_loans(
    ", long AS (SELECT 'score' AS name, score AS value FROM lv)" + KDE.format(g="name", out="name")))
def kde(spark, sf_dir):
    return profile.kde(L.loans(spark, sf_dir), "score")


@query("kde_by_class", on_loans(
    ", long AS (SELECT event, 'score' AS name, score AS value FROM lv)"
    + KDE.format(g="event, name", out="CAST(event AS BIGINT) AS event, name")))
def kde_by_class(spark, sf_dir):
    return profile.kde(L.loans(spark, sf_dir), "score", [L.EVENT])


@query("iqr_outliers", on_loans(f""", {LONG}
, q AS (SELECT name, quantile_cont(value, 0.25e0) AS q1, quantile_cont(value, 0.75e0) AS q3 FROM long GROUP BY name)
, f AS (SELECT name, q1, q3, q1 - 1.5e0 * (q3 - q1) AS low, q3 + 1.5e0 * (q3 - q1) AS high FROM q)
, o AS (SELECT name, count(*) FILTER (value < low OR value > high) AS n_outliers FROM long JOIN f USING (name) GROUP BY name)
SELECT name, round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high, n_outliers,
       round(100e0 * n_outliers / (SELECT count(*) FROM lv), 4) AS pct FROM f JOIN o USING (name)"""), digits=4)
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(L.loans(spark, sf_dir), L.NUMBERS)


@query("crosstab_cube", on_loans("""
SELECT CASE WHEN grouping(employment) = 1 THEN 'All' ELSE employment END AS employment,
       CASE WHEN grouping(event) = 1 THEN 'All' ELSE CAST(event AS VARCHAR) END AS event, count(*) AS n
FROM lv WHERE employment IS NOT NULL AND event IS NOT NULL GROUP BY CUBE (employment, event)"""))
def crosstab_cube(spark, sf_dir):
    return profile.crosstab(L.loans(spark, sf_dir), "employment", L.EVENT)


@query("rate_by_category", on_loans("""
SELECT credit_type AS value, count(*) AS n, round(100e0 * avg(event), 6) AS event_pct FROM lv
WHERE credit_type IS NOT NULL GROUP BY 1"""))
def rate_by_category(spark, sf_dir):
    return profile.rate_by_category(L.loans(spark, sf_dir), "credit_type", L.EVENT)


ALL_CATEGORIES = [*L.CATEGORIES, "income_trend"]
_CELLS = ", cells AS (" + union_all("SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, event FROM lv WHERE {c} IS NOT NULL", ALL_CATEGORIES) + ")"


@query("category_frequencies_all", on_loans(_CELLS + " SELECT name, value, count(*) AS n FROM cells GROUP BY 1, 2"))
def category_frequencies_all(spark, sf_dir):
    return profile.frequencies(L.loans(spark, sf_dir), ALL_CATEGORIES)


@query("rate_by_category_all", on_loans(
    _CELLS + " SELECT name, value, count(*) AS n, round(100e0 * avg(event), 6) AS event_pct FROM cells GROUP BY 1, 2"))
def rate_by_category_all(spark, sf_dir):
    return profile.rates_by_category(L.loans(spark, sf_dir), ALL_CATEGORIES, L.EVENT)


@query("histogram_by_class_all", on_loans(
    ", long AS (" + union_all("SELECT event, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM lv WHERE {c} IS NOT NULL", L.NUMBERS) + ")"
    f" {histogram_sql('event, name', 40)} SELECT name, CAST(event AS BIGINT) AS event, bin, n, density FROM out"), digits=4)
def histogram_by_class_all(spark, sf_dir):
    """Counts and densities; limits are compared in ``histogram`` and ``histogram_by_class``."""
    return profile.histogram(L.loans(spark, sf_dir), L.NUMBERS, 40, [L.EVENT]).select("name", L.EVENT, "bin", "n", "density")


EDGES = f"""
, eg AS (SELECT name, list_sort(list_distinct(quantile_cont(value, {prob_list(10)}))) AS edges FROM long GROUP BY name)
, bn AS (SELECT long.name, event, edges, {bin_sql('value', 'edges')} AS bin FROM long JOIN eg USING (name))"""


@query("rate_by_decile", on_loans(f""", {LONG} {EDGES}
SELECT name, CAST(bin AS BIGINT) AS bin, round(avg(event), 4) AS event_rate, count(*) AS n,
       round(any_value(edges[bin]), 4) AS lo, round(any_value(edges[bin + 1]), 4) AS hi
FROM bn GROUP BY name, bin"""), digits=4)
def rate_by_decile(spark, sf_dir):
    return profile.rate_by_quantile(L.loans(spark, sf_dir), L.NUMBERS, L.EVENT)


CORR_COLS = L.NUMBERS + ["event"]
_pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]


@query("corr_matrix", on_loans(" " + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM lv"
    for a, b in _pairs)))
def corr_matrix(spark, sf_dir):
    return association.correlation_pairs(L.loans(spark, sf_dir), CORR_COLS)


@query("corr_ranking", on_loans(" " + union_all(
    "SELECT '{c}' AS name, round(corr(CAST({c} AS DOUBLE), CAST(event AS DOUBLE)), 6) AS corr FROM lv", L.NUMBERS)))
def corr_ranking(spark, sf_dir):
    return association.correlation_ranking(L.loans(spark, sf_dir), L.NUMBERS, L.EVENT)


WELCH = f""", {LONG}
, g AS (SELECT name, event, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM long GROUP BY name, event)
, p AS (SELECT a.name, a.m AS mean0, b.m AS mean1, a.v / a.n AS e0, b.v / b.n AS e1, a.n AS n0, b.n AS n1
        FROM g a JOIN g b ON a.name = b.name AND a.event = 0 AND b.event = 1)"""


@query("welch_t", on_loans(f"""{WELCH}
SELECT name, round(mean0, 4) AS mean0, round(mean1, 4) AS mean1,
       round((mean0 - mean1) / sqrt(e0 + e1), 4) AS t_stat,
       round((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 4) AS df FROM p"""), digits=4)
def welch_t(spark, sf_dir):
    return association.welch_stats(L.loans(spark, sf_dir), L.NUMBERS, L.EVENT)


def _tail_sql(source: str, keep: str, start: str, log_density: str, times: int) -> str:
    """Upper tail of a density from ``start`` on, by Simpson's rule over s with x = start + s / (1 - s)."""
    steps = 4000
    return f"""
, tail_points AS (SELECT s.*, i, i / {steps}e0 AS s, {start} + i / {steps}e0 / (1 - i / {steps}e0) AS x
  FROM {source} s, (SELECT unnest(range(0, {steps})) AS i))
, tails AS (SELECT name, {', '.join(f'any_value({c}) AS {c}' for c in keep.split())},
    {times} * sum((CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp({log_density}) / ((1 - s) * (1 - s))) / (3 * {steps}e0) AS p_value
  FROM tail_points GROUP BY name)"""


def _stars_sql(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} < {limit!r} THEN '{label}'" for limit, label in K.SIGNIFICANCE) + f" ELSE '{K.NOT_SIGNIFICANT}' END"


T_DENSITY = "lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5e0 * ln(df * pi()) - (df + 1) / 2 * ln(1 + x * x / df)"
CHI_DENSITY = "(df / 2e0 - 1) * ln(x) - x / 2 - df / 2e0 * ln(2e0) - lgamma(df / 2e0)"


@query("welch_significance", on_loans(f"""{WELCH}
, stat AS (SELECT name, mean0, mean1, (mean0 - mean1) / sqrt(e0 + e1) AS t_stat,
    (e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)) AS df FROM p)
{_tail_sql('stat', 'mean0 mean1 t_stat df', 'abs(t_stat)', T_DENSITY, 2)}
SELECT name, round(mean0, 4) AS mean0, round(mean1, 4) AS mean1, round(t_stat, 4) AS t_stat, round(df, 4) AS df,
       round(p_value, 4) AS p_value, {_stars_sql('p_value')} AS significance FROM tails"""), digits=4)
def welch_significance(spark, sf_dir):
    return association.welch_test(L.loans(spark, sf_dir), L.NUMBERS, L.EVENT)


CAT_LONG = "cl AS (" + union_all(
    "SELECT '{c}' AS name, {c} AS category, event FROM lv WHERE {c} IS NOT NULL",
    L.CATEGORIES + ["income_trend"]) + ")"


@query("chi2", on_loans(f""", {CAT_LONG}
, o AS (SELECT name, category, count(*) FILTER (event = 0) AS o0, count(*) FILTER (event = 1) AS o1
        FROM cl GROUP BY name, category)
, t AS (SELECT name, sum(o0) AS t0, sum(o1) AS t1, count(*) AS k FROM o GROUP BY name)
, e AS (SELECT o.*, k, (o0 + o1) * t0 / (t0 + t1) AS e0, (o0 + o1) * t1 / (t0 + t1) AS e1 FROM o JOIN t USING (name))
SELECT name, round(sum((o0 - e0) * (o0 - e0) / e0 + (o1 - e1) * (o1 - e1) / e1), 6) AS chi2,
       max(k) - 1 AS df FROM e GROUP BY name"""))
def chi2(spark, sf_dir):
    return association.chi2_stats(L.loans(spark, sf_dir), L.CATEGORIES + ["income_trend"], L.EVENT)


@query("chi2_significance", on_loans(f""", {CAT_LONG}
, o AS (SELECT name, category, count(*) FILTER (event = 0) AS o0, count(*) FILTER (event = 1) AS o1
        FROM cl GROUP BY name, category)
, t AS (SELECT name, sum(o0) AS t0, sum(o1) AS t1, count(*) AS k FROM o GROUP BY name)
, e AS (SELECT o.*, k, (o0 + o1) * t0 / (t0 + t1) AS e0, (o0 + o1) * t1 / (t0 + t1) AS e1 FROM o JOIN t USING (name))
, stat AS (SELECT name, sum((o0 - e0) * (o0 - e0) / e0 + (o1 - e1) * (o1 - e1) / e1) AS chi2, CAST(max(k) - 1 AS BIGINT) AS df
  FROM e GROUP BY name)
{_tail_sql('stat', 'chi2 df', 'chi2', CHI_DENSITY, 1)}
SELECT name, round(chi2, 4) AS chi2, df, round(p_value, 4) AS p_value, {_stars_sql('p_value')} AS significance FROM tails"""), digits=4)
def chi2_significance(spark, sf_dir):
    return association.chi2_test(L.loans(spark, sf_dir), L.CATEGORIES + ["income_trend"], L.EVENT)


WOE = f""", {LONG} {EDGES}
, ab AS (SELECT name, CAST(bin AS VARCHAR) AS bin, event FROM bn
         UNION ALL SELECT 'employment', employment, event FROM lv WHERE employment IS NOT NULL)
, ct AS (SELECT name, bin, count(*) AS total, CAST(sum(event) AS BIGINT) AS events FROM ab GROUP BY name, bin)
, ds AS (SELECT *, total - events AS non_events, events / sum(events) OVER (PARTITION BY name) AS dist_ev,
                (total - events) / sum(total - events) OVER (PARTITION BY name) AS dist_nev FROM ct)
, wo AS (SELECT *, ln((dist_ev + 1e-9) / (dist_nev + 1e-9)) AS woe FROM ds)
, iv AS (SELECT *, (dist_ev - dist_nev) * woe AS iv_bin FROM wo)"""


def _woe(spark, sf_dir):
    return association.woe_bins(L.loans(spark, sf_dir), L.NUMBERS, L.EVENT, ["employment"])


@query("woe_bins", on_loans(WOE + """
SELECT name, bin, total, events, non_events, round(dist_ev, 6) AS dist_ev, round(dist_nev, 6) AS dist_nev,
       round(woe, 6) AS woe, round(iv_bin, 6) AS iv_bin FROM iv"""))
def woe_bins(spark, sf_dir):
    return _woe(spark, sf_dir)


@query("iv_rank", on_loans(WOE + """
, r AS (SELECT name, sum(iv_bin) AS iv FROM iv GROUP BY name)
SELECT name, round(iv, 6) AS iv, CASE WHEN iv < 0.02 THEN 'Inútil' WHEN iv < 0.1 THEN 'Débil'
  WHEN iv < 0.3 THEN 'Medio' WHEN iv < 0.5 THEN 'Fuerte' ELSE '⚠️ Sospechoso' END AS power FROM r"""))
def iv_rank(spark, sf_dir):
    return association.iv_ranking(_woe(spark, sf_dir))
