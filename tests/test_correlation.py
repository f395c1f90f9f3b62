"""Pairwise correlations from merged matrices against pandas, with nulls, constants and many columns."""

import numpy as np
import pandas as pd
import pytest

from lendscope.operators import association


def wide(rows, columns, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, 6)) @ r.normal(size=(6, columns)) + r.normal(size=(rows, columns)) + r.normal(size=columns) * 1000
    x[r.random(x.shape) < 0.15] = np.nan
    x[:, 0] = 0.1
    x[1:, 1] = np.nan
    x[:, 2] = np.nan
    return pd.DataFrame(x, columns=[f"c {i}" for i in range(columns)])


def check(spark, frame, monkeypatch=None, block=None):
    if block:
        monkeypatch.setattr(association, "BLOCK", block)
    df = spark.createDataFrame(frame)
    got = {(r.a, r.b): r["corr"] for r in association.correlation_pairs(df.repartition(4), list(frame.columns)).collect()}
    frame = frame.copy()
    frame[frame.columns[0]] = np.nan  # pandas gives noise or nothing for a constant; here it is null
    want = frame.corr()
    assert len(got) == len(frame.columns) * (len(frame.columns) - 1) // 2
    for (a, b), value in got.items():
        w = want.loc[a, b]
        assert (value is None and np.isnan(w)) or value == pytest.approx(w, abs=1e-9), (a, b)


def test_many_columns_in_one_pass(spark):
    check(spark, wide(300, 140, 1))


@pytest.mark.parametrize("block", [1, 4, 50])
def test_any_block_size(spark, block, monkeypatch):
    check(spark, wide(120, 11, 2), monkeypatch, block)


def test_no_rows_and_ranking(spark):
    frame = wide(50, 5, 3)
    df = spark.createDataFrame(frame)
    assert all(r["corr"] is None for r in association.correlation_pairs(df.limit(0), ["c 3", "c 4"]).collect())
    frame["event"] = (frame["c 3"].fillna(0) > frame["c 3"].mean()).astype(int)
    top = association.correlation_ranking(spark.createDataFrame(frame), ["c 0", "c 3", "c 4"], "event").collect()
    want = frame.corr().loc["c 3", "event"]
    assert top[0]["name"] == "c 3" and top[0]["corr"] == pytest.approx(want, abs=1e-9) and top[-1]["corr"] is None
