"""What a pass over TF-IDF vectors costs: texts read once, rows multiplied as dense ones, queries in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import queries
from eventloom.operators import joins, learn, search


@pytest.mark.parametrize("share, dense", [(0.2, True), (0.002, False)])
def test_products_of_dense_and_of_sparse_rows(monkeypatch, share, dense):
    r, times = np.random.default_rng(5), []
    monkeypatch.setattr(learn, "_times", lambda *x, f=learn._times: (times.append(1), f(*x))[1])
    monkeypatch.setattr(learn, "DENSE_CELLS", 7 * 60)
    a = r.standard_normal((50, 60)) * (r.random((50, 60)) < share)
    a[[0, 13, 49]] = 0
    m = r.standard_normal((60, 9))
    row, col = np.nonzero(a)
    out, squares = learn._products(row, col, a[row, col], len(a), m, True)
    assert np.allclose(out, a @ m) and np.allclose(squares, a.T @ (a @ m)) and bool(times) != dense
    out, squares = learn._products(row, col, a[row, col], len(a), m, False)
    assert np.allclose(out, a @ m) and squares is None
    out, squares = learn._products(row[:0], col[:0], a[row[:0], col[:0]], 0, m, True)
    assert out.shape == (0, 9) and squares.shape == m.shape and not squares.any()


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    """Each text is split into words once, however many passes there are over the vectors, and these are turned once."""
    words = ["sun", "moon", "star", "sky", "rain", "wind", "snow", "leaf"]
    rows = [(i, " ".join(words[(i * j) % 8] for j in range(1, 5 + i % 3)) if i % 7 else None) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    split = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        split.add(1)
        return text

    monkeypatch.setattr(queries, "t", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").withColumn("text", counted("text")))
    found = queries.QUERIES["svd_neighbours"](spark, str(tmp_path))
    assert sorted(tuple(x) for x in found.groupBy("query_id").count().collect()) == [(50, 5), (100, 5)]  # 0 has no text
    assert split.value == len(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_counted_words_give_the_same_vectors(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, None), (3, "B c, d")], "doc_id long, text string")
    key = lambda x: sorted((r.doc_id, r.vector) for r in x.collect())
    stored = learn.tfidf(df, 64, lambda counts: joins.shared(counts.drop("text")))
    assert stored.columns == ["doc_id", "vector"] and key(stored) == key(learn.tfidf(df, 64))


def test_nearest_by_blocks_of_queries(monkeypatch):
    monkeypatch.setattr(search, "CELLS", 300)
    r = np.random.default_rng(8)
    v = r.standard_normal((900, 6))
    v[r.random(len(v)) < 0.3] = v[0]
    v /= np.sqrt((v * v).sum(1))[:, None]
    own = r.permutation(len(v))
    top = search._Best(v[:70], own[:70], 5, None)
    for lo in range(0, len(v), 40):
        top.add(v[lo : lo + 40], own[lo : lo + 40], np.zeros(40, object)[: len(v) - lo])
    at, near, sims, _ = top.rows()
    all_ = np.round(v[:70] @ v.T, 6)
    want = [(i, own[j], all_[i, j]) for i in range(70) for j in [j for j in np.lexsort((own, -all_[i])) if own[j] != own[i]][:5]]
    assert list(zip(at, near, sims, strict=True)) == want
    assert len(top.room) <= 300
