import random

import numpy as np
import pandas as pd
import pytest

from retenta.operators import collinearity


def test_correlations_over_the_rows_that_have_both(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = rng.gauss(1e6, 1)
        rows.append([x if rng.random() > .2 else None for x in (a, 2 * a + rng.gauss(0, 3), rng.gauss(0, 1), 5.0)])
    want = pd.DataFrame(rows, columns=list("abcd"), dtype=float).corr().to_numpy()
    got = collinearity.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5), list("abcd"))
    assert np.isnan(got[3]).all() and np.allclose(got[:3, :3], want[:3, :3], atol=1e-9)


def test_pairs_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, None), (None, 3.0, 2.0), (None, 5.0, None)], "a double, b double, c double")
    m = collinearity.correlation_matrix(df, ["a", "b", "c"])
    assert np.isnan(m[0, 1]) and np.isnan(m[0, 2]) and m[0, 0] == pytest.approx(1)
    assert np.isnan(collinearity.correlation_matrix(df.limit(0), ["a", "b"])).all()
