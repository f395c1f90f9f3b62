import math

import pytest
from pyspark.sql import functions as F

from lendscope.functions import expressions as E
from lendscope.functions.tails import chi2_upper, incomplete_beta, student_t_two_sided
from lendscope.operators import features, rules


def column(df, name):
    return [r[name] for r in df.orderBy("i").select(name).collect()]


def frame(spark, values, kind, name="x"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} {kind}")


def test_left_closed_bucket_boundaries(spark):
    labels = [f"b{i}" for i in range(1, 7)]
    df = frame(spark, [17, 18, 25, 26, 66, 119, 120, None], "int")
    out = df.withColumn("b", E.bucket(F.col("x"), [18, 26, 36, 46, 56, 66, 120], labels))
    assert column(out, "b") == [None, "b1", "b1", "b2", "b6", "b6", None, None]


def test_right_closed_bucket_boundaries(spark):
    df = frame(spark, [0.0, 0.1, 1.0, 1.5, 2.0, 2.1], "double")
    out = df.withColumn("b", E.bucket(F.col("x"), [0, 1, 2], ["lo", "hi"], right=True))
    assert column(out, "b") == [None, "lo", "lo", "hi", "hi", None]


def test_whole_days_floor(spark):
    df = spark.sql(
        "SELECT 0 AS i, TIMESTAMP_NTZ'2025-09-30 12:00:00' AS t UNION ALL SELECT 1, TIMESTAMP_NTZ'2026-02-28 12:00:00'"
    )
    assert column(df.withColumn("d", E.whole_days_until("2026-02-28", F.col("t"))), "d") == [150, -1]


def test_ratio_zero_null_text_and_offset(spark):
    df = spark.createDataFrame([(0, 6.0, "2"), (1, 6.0, "0"), (2, 6.0, "abc"), (3, None, "2")], "i int, n double, d string")
    out = df.withColumns({
        "plain": E.ratio(F.col("n"), F.col("d")), "plus": E.ratio(F.col("n"), F.col("d"), 1),
        "gap": E.ratio(F.col("n"), F.col("d"), -2),
    })
    assert column(out, "plain") == [3.0, None, None, None]
    assert column(out, "plus") == [2.0, 6.0, None, None]
    assert column(out, "gap") == [None, -3.0, None, None]


def test_all_zero_denominator(spark):
    df = frame(spark, [0, 0, 0], "int", "loans").withColumn("asked", F.lit(4))
    spec = {"name": "r", "numerator": "asked", "denominator": "loans"}
    assert column(features.ratio_features(df, [spec]), "r") == [None, None, None]
    assert column(features.ratio_features(df, [{**spec, "denominator_add": 1}]), "r") == [4.0, 4.0, 4.0]


def test_event_flag_counts_missing_label_as_no_event(spark):
    assert column(frame(spark, [0, 1, None], "int").withColumn("e", E.event_flag(F.col("x"))), "e") == [1, 0, 0]


def test_catalogue_cleaning_is_case_sensitive(spark):
    df = frame(spark, ["flat", "Flat", "999", None], "string")
    out = features.clean_categories(df, {"x": ["flat", "up"], "absent": ["a"]})
    assert column(out, "x") == ["flat", None, None, None]


def test_risk_band_and_decision(spark):
    df = frame(spark, [0.1, 0.2, 0.3, 0.35], "double")
    out = df.withColumns({"band": E.risk_band(F.col("x"), 0.3), "p": E.decision(F.col("x"), 0.3)})
    assert column(out, "band") == ["Bajo", "Medio", "Alto", "Alto"]
    assert column(out, "p") == [0, 0, 1, 1]


def test_step_labels(spark):
    df = frame(spark, [0.0005, 0.001, 0.02, 0.3, None], "double")
    out = df.withColumns({"s": E.significance(F.col("x")), "v": E.iv_power(F.col("x")), "d": E.psi_status(F.col("x"))})
    assert column(out, "s") == ["***", "**", "*", "ns", None]
    assert column(out, "v") == ["Inútil", "Inútil", "Débil", "Fuerte", None]
    assert column(out, "d") == ["Estable", "Estable", "Estable", "Drift", None]


def test_event_names():
    names = E.event_names("late_pay")
    assert (names["score_col"], names["pred_col"], names["actual_col"], names["event_title"]) == (
        "score_late_pay", "pred_late_pay", "late_pay_real", "Late Pay")


def test_parse_timestamp_bad_and_zoned(spark):
    df = frame(spark, ["2024-03-01", "2024-03-01T05:00:00+05:00", "nope", None], "string")
    got = column(df.withColumn("t", E.parse_timestamp("x").cast("string")), "t")
    assert got == ["2024-03-01 00:00:00", "2024-03-01 00:00:00", None, None]


def test_derive_is_idempotent_and_ordered(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0)], "i int, a double, b double")
    spec = {
        "ratios": [{"name": "r", "numerator_sum": ["a", "b"], "denominator": "b"}],
        "sums": [{"name": "s", "cols": ["a", "b"]}],
        "shares": [{"name": "p", "numerator": "a", "denominator": "s"}],
    }
    once = features.derive(df, spec)
    assert once.first().asDict() == {"i": 0, "a": 1.0, "b": 3.0, "r": 4 / 3, "s": 4.0, "p": 0.25}
    assert features.derive(once, spec).columns == once.columns
    assert df.columns == ["i", "a", "b"]


def test_weekday_and_missing_date_column(spark):
    df = spark.sql("SELECT 0 AS i, TIMESTAMP_NTZ'2024-01-02 00:00:00' AS t")
    out = features.date_features(df, "t", {"reference_date": "2024-01-05"})
    assert out.first()["weekday"] == "Tuesday" and out.first()["age_days"] == 3
    assert features.date_features(df, "absent", {"reference_date": "2024-01-05"}).columns == ["i", "t"]


def test_required_columns_error_lists_missing(spark):
    with pytest.raises(ValueError, match="nope"):
        features.require_columns(frame(spark, [1], "int"), ["x", "nope"])


RULES = [
    {"col": "bureau", "op": "<", "threshold": 760},
    {"col": "asked", "op": ">", "threshold": 5},
    {"col": "term", "op": ">", "threshold": 12},
]


def test_rules_known_rows(spark):
    df = spark.createDataFrame([(0, 700, 8, 18), (1, 900, 1, 6), (2, None, 8, 18)], "i int, bureau int, asked int, term int")
    out = rules.add_rule_score(df, RULES, 2)
    assert column(out, "pred") == [1, 0, 1]
    assert column(out, "signals") == [3, 0, 2]


def test_rule_null_semantics_suffix_and_errors(spark):
    df = frame(spark, [None, 1], "int", "numeric__x")
    signal = lambda op: column(df.withColumn("s", rules.rule_signal(df, {"col": "x", "op": op, "threshold": 1})), "s")
    assert signal("<") == [0, 0]
    assert signal("!=") == [1, 0]
    assert signal("==") == [0, 1]
    with pytest.raises(ValueError):
        signal("~")
    with pytest.raises(ValueError):
        rules.rule_columns(df, [])
    with pytest.raises(KeyError):
        E.find_column(df, "y")


def test_prefix_finder_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Saldo_a int, saldo_b int, c int")
    assert E.columns_with_prefix(df, "saldo") == ["Saldo_a", "saldo_b"]


def test_tail_probabilities():
    # Fixed values from the standard tables of the t and chi-square distributions.
    assert student_t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert student_t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    assert chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert chi2_upper(2.0, 2) == pytest.approx(math.exp(-1.0), abs=1e-12)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)


def test_key_hash_spreads_evenly(spark):
    p = E.HASH_MODULUS
    df = spark.range(0, 20000).select(E.key_hash(F.col("id"), 7).alias("h"))
    assert df.distinct().count() == 20000
    row = df.agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.avg("h").alias("m")).first()
    assert 0 <= row["lo"] and row["hi"] < p and abs(row["m"] / p - 0.5) < 0.02
