"""Truncated SVD against numpy's."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from eventloom.operators import learn


def test_svd_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = (rng.standard_normal((300, 12)) * np.array([40, 30, 22, 15, 10, 7, 1, 1, 0.5, 0.5, 0.2, 0.1])) @ np.linalg.qr(rng.standard_normal((80, 12)))[0].T
    m[np.abs(m) < 1] = 0
    rows = [(i, Vectors.dense(x) if i % 3 == 0 else Vectors.sparse(80, [(j, float(v)) for j, v in enumerate(x) if v])) for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, ["id", "vector"]).repartition(3)
    monkeypatch.setattr(learn, "ENTRIES", 700)
    monkeypatch.setattr(learn, "COLUMNS", 32)
    got = learn.svd(df, 5, more=5)
    _, s, v = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(got.singular, s[:5], rtol=1e-6)
    # the same subspace: the cosines of the angles between both are ones
    assert np.allclose(np.linalg.svd(v[:5] @ got.components)[1], 1, atol=1e-6)
    out = {r.id: np.array(r.embedding) for r in got.transform(df).collect()}
    assert np.allclose(np.stack([out[i] for i in range(300)]), m @ got.components)


def test_svd_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(4, {1: 2.0}))], ["id", "vector"])
    got = learn.svd(df, 100)
    assert got.singular[0] == pytest.approx(2) and np.allclose(got.singular[1:], 0) and got.components.shape == (4, 4)
    none = learn.svd(df.limit(0), 3)
    assert np.allclose(none.singular, 0) and none.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cells"):
        learn.svd(spark.createDataFrame([(1, Vectors.sparse(1 << 22, {1: 2.0}))], ["id", "vector"]), 5)
