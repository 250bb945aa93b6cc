"""The distributed logistic regression against one fit for each fold over its own rows."""

import numpy as np
import pytest

from tidewatch.functions import kernels as K
from tidewatch.operators import linear


def test_held_out_scores(spark):
    r = np.random.default_rng(3)
    n = 150
    x = r.normal(size=(n, 3)) * [1, 10, 0] + [0, 5, 2]
    y = (x[:, 0] + r.normal(size=n) > 0.5).astype(int)
    g = np.arange(n) % 3
    x[r.random((n, 3)) < 0.1] = np.nan
    x[[0, 4, 8], 0] = np.nan
    rows = [(i, int(g[i]), int(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]
    frame = spark.createDataFrame([*rows, (1000, None, 1, 1.0, 1.0, 1.0), (1001, 1, None, 1.0, 1.0, 1.0)], "row_id long, fold int, target int, a double, b double, c double").repartition(5)
    got = {r.row_id: (r.fold, r.y, r.score) for r in linear.held_out(frame, list("abc")).collect()}
    assert len(got) == n
    for k in range(3):
        own = g != k
        fill = np.array([np.sort(v[~np.isnan(v)])[(np.sum(~np.isnan(v)) - 1) // 2] for v in x[own].T])
        z = np.where(np.isnan(x), fill, x)
        want = K.logistic_score(K.logistic(z[own], y[own].astype(float)), z[~own])
        for i, s in zip(np.flatnonzero(~own).tolist(), want, strict=True):
            assert got[i][:2] == (k, y[i]) and got[i][2] == pytest.approx(s, abs=1e-7)


def test_one_class_and_empty(spark):
    rows = spark.createDataFrame([(i, i % 2, i % 2, float(i)) for i in range(10)], "row_id long, fold int, target int, a double")
    assert {(r.fold, r.score) for r in linear.held_out(rows, ["a"]).collect()} == {(0, 1.0), (1, 0.0)}  # the other fold has one class
    assert linear.held_out(rows.limit(0), ["a"]).isEmpty()
