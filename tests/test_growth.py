"""Steps whose tasks must not grow with the tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lendscope.llm import licenses
from lendscope.operators import boosting, scoring, splits, training
from lendscope.plans import loans, model_queries


def test_shuffles_are_compiled_with_the_scan(spark):
    parts = splits.shuffle_parts(spark.range(500).withColumnRenamed("id", "key"), "key", 3, (0.5, 1.0))
    assert "lambda" not in parts._jdf.queryExecution().toString()
    counts = parts.select(F.posexplode("parts").alias("r", "part")).groupBy("r", "part").count()
    assert sorted(tuple(r) for r in counts.collect()) == [(r, p, n) for r in range(3) for p, n in ((0, 100), (1, 200), (2, 200))]


def test_partitions_of_a_matrix_grow_with_its_rows(spark):
    assert [model_queries.partitions(spark.range(n)) for n in (0, 10, 950_000)] == [4, 4, 10]


def test_loans_are_joined_in_more_tasks_from_larger_files(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id % 15 AS l_orderkey", "id % 4 AS l_suppkey", "id * 1.5D AS l_extendedprice", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag"
                               ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).selectExpr("IF(id = 3, NULL, id) AS o_orderkey", "IF(id = 5, NULL, id % 7) AS o_custkey", "'F' AS o_orderstatus", "id * 100D AS o_totalprice",
                               "timestamp_ntz'2000-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(6).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment", "id * 10D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    files = loans.input_state(spark, str(tmp_path))
    assert loans.loan_parts(spark, files) == 1
    monkeypatch.setattr(loans, "PART_BYTES", 100)
    parts = loans.loan_parts(spark, files)
    assert parts == -(-sum(f[1] for f in files) // 100) > spark.sparkContext.defaultParallelism
    rows = [sorted(map(str, loans.loans_plan(spark, str(tmp_path), n).collect())) for n in (1, parts)]
    assert rows[0] == rows[1] and len(rows[0]) == 20


def test_a_task_folds_its_rows_into_sums_per_bin():
    r = np.random.default_rng(1)
    bins, y, w, score = r.integers(0, 3, (50, 2)), r.integers(0, 2, 50) * 1.0, r.random(50), r.random(50)
    batch = pa.RecordBatch.from_arrays([pa.array(bins.tolist(), pa.list_(pa.int32())), *map(pa.array, (y, w, score))], ["bins", "y", "w", "score"])
    leaf = lambda n, value: {"node": n, "feature": None, "cut": None, "bin": None, "low": None, "high": None, "value": value, "gain": 0.0}
    tree = [{**leaf(0, 0.0), "feature": 1, "bin": 2, "low": 1, "high": 2}, leaf(1, 0.5), leaf(2, -0.25)]
    (got,) = boosting.folded([tree], tree, 1, [2], [3, 3])(iter([batch.slice(0, 20), batch.slice(20)]))
    margin = score + np.where(bins[:, 1] < 2, 0.5, -0.25)
    p, want = 1 / (1 + np.exp(-margin)), {}
    for row in np.flatnonzero(bins[:, 1] >= 2):
        for f in (0, 1):
            g, h, n = want.get((2, f, bins[row, f]), (0, 0, 0))
            want[2, f, bins[row, f]] = (g + w[row] * (p[row] - y[row]), h + w[row] * p[row] * (1 - p[row]), n + 1)
    found = {(x["node"], x["feature"], x["bin"]): (x["g"], x["h"], x["n"]) for x in got.to_pylist()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)


def test_a_probability_is_worked_out_once_a_row(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "key int, a double, b double, event int")
    model = training.fit_classifier({"type": "logistic_regression"}, rows, "event", ["a", "b"])
    scored = training.add_probability(model, rows, ["a", "b"], "_score")
    assert [r["_score"] for r in scored.orderBy("key").collect()] == [r["probability"][1] for r in model.transform(training.assemble(rows, ["a", "b"])).orderBy("key").collect()]
    columns = scoring.prediction_columns(F.col("_score"), F.col("key"), "event", 0.5, "1", F.lit(None).cast("timestamp_ntz"))
    used = scored.select("key", *[c.alias(n) for n, c in columns.items()]).where("score_event IS NOT NULL AND pred_event >= 0")
    assert used.count() == 60
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 4


def test_prose_meets_no_licence_template(spark):
    """Units without enough bigrams of any template leave before the join with templates; others keep their coefficient."""
    mit = next(text for _, text in licenses.TEMPLATES if text.startswith("Released under the MIT"))
    rows = [(1, "the public may copy a permit to license plates"), (2, mit), (3, f"{mit} ok"), (4, "licensed license the under the mit")]
    scan = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["license"]) for r in scan.collect()} >= {(2, "MIT"), (3, "MIT")}
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner, ((bigrams")
    assert "INSET" in plan[join:]
