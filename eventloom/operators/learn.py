"""Experiments on text: TF-IDF, a low-dimensional code, k-means, and a sparse winner-take-all code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tfidf(df: DataFrame, dims: int = 1 << 12, counted: Callable[[DataFrame], DataFrame] = lambda counts: counts) -> DataFrame:
    """df with `vector`, of length one. counted: what the rows go through once the words of their texts are counted; where it stores them,
    texts are read once, and not again for each pass over the vectors."""
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    words = RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+").transform(df)
    counts = counted(HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words).drop("_w"))
    stages = [IDF(inputCol="_tf", outputCol="_i"), Normalizer(inputCol="_i", outputCol="vector")]
    return Pipeline(stages=stages).fit(counts).transform(counts).drop("_tf", "_i")


def clusters(df: DataFrame, k: int, dims: int = 1 << 10, seed: int = 7) -> DataFrame:
    """doc_id, cluster by k-means over TF-IDF vectors."""
    v = tfidf(df, dims)
    return KMeans(k=k, seed=seed, maxIter=5, featuresCol="vector", predictionCol="cluster").fit(v).transform(v).select("doc_id", "cluster")


def sparse_code(df: DataFrame, bits: int = 2048, share: float = 0.05, seed: int = 7) -> DataFrame:
    """vec_id, code: the places of the largest `share` of `bits` random sums of a vector's components."""
    top = max(1, int(bits * share))

    def run(parts):
        weights = None
        for part in parts:
            x = np.stack(part["embedding"].to_numpy()) if len(part) else np.zeros((0, 1))
            if weights is None:
                weights = (np.random.default_rng(seed).random((x.shape[1], bits)) < 0.1).astype(np.float32)
            code = np.sort(np.argpartition(-(x @ weights), top - 1, 1)[:, :top], 1)
            yield pd.DataFrame({"vec_id": part["vec_id"], "code": list(code.astype(np.int32))})

    return df.select("vec_id", "embedding").mapInPandas(run, "vec_id long, code array<int>")


def ppmi(texts: DataFrame, words: str = "words", window: int = 2, least: int = 20) -> DataFrame:
    """a, b, count, ppmi of words that stand within `window` places of each other, both ways, where they do so more often than by
    chance. words: an array of the text's words; those that stand fewer than `least` times take places, but no part."""
    kept = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("w")
    near = lambda k: F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - k, F.lit(0))), F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = texts.select(F.explode(F.flatten(F.array(*[near(k) for k in range(1, window + 1)]))).alias("p")).select("p.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.join(kept.withColumnRenamed("w", "a"), "a").join(kept.withColumnRenamed("w", "b"), "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).groupBy("a", "b").agg(F.sum("c").alias("count"))
    of = both.groupBy("a").agg(F.sum("count").alias("_n"))
    total = both.agg(F.sum("count").alias("_all"))
    joined = both.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("_n").alias("_m")), "b").join(F.broadcast(total))  # one row
    out = joined.withColumn("ppmi", F.log(F.col("count") * F.col("_all") / (F.col("_n") * F.col("_m"))))
    return out.filter("ppmi > 0").select("a", "b", "count", "ppmi")


def word_vectors(pairs: DataFrame, dims: int = 100, context: int = 2000) -> DataFrame:
    """word, vector: the rows of ppmi() over the `context` most frequent words, in their `dims` principal components."""
    columns = [r.b for r in pairs.groupBy("b").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "b").limit(context).collect()]
    place = F.create_map(*[F.lit(x) for i, w in enumerate(columns) for x in (w, i)])
    rows = pairs.withColumn("i", place[F.col("b")]).filter("i is not null").groupBy(F.col("a").alias("word")).agg(F.map_from_entries(F.collect_list(F.struct("i", "ppmi"))).alias("m"))
    dense = rows.select("word", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias("x"))
    return PCA(k=min(dims, len(columns)), inputCol="x", outputCol="vector").fit(dense).transform(dense).select("word", "vector")


#: Cells of a matrix of columns by components that is sent to all tasks, and entries that a task multiplies at once.
MOST_CELLS, ENTRIES = 16 << 20, 1 << 15
#: Rows are multiplied as a dense matrix, of so many cells at once, where one cell in so many has an entry: such a product is as fast as
#: that of the entries alone if about one in 145 has one, measured with 4096 columns and 110 directions.
DENSE_CELLS, DENSE = 4 << 20, 128
#: Tasks of a pass: each sends one such matrix on, in parts of so many columns.
TASKS, COLUMNS = 256, 1024


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors as ML keeps them: row, column and value of each entry that is not zero; a null vector has none."""
    vectors = batch.column(0)
    none = vectors.is_null().to_numpy(zero_copy_only=False)
    indices, values = vectors.field(2), vectors.field(3)
    size = np.where(none, 0, values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(size)), size)
    flat = values.filter(pa.array(~none)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dense = indices.is_null().to_numpy(zero_copy_only=False)[row]  # these have no indices
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    place[~dense] = indices.filter(pa.array(~none)).flatten().to_numpy(zero_copy_only=False)
    return row[flat != 0], place[flat != 0], flat[flat != 0]


def _times(row: np.ndarray, col: np.ndarray, value: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
    """Entries times a dense matrix, some at a time."""
    out = np.zeros((rows, m.shape[1]))
    for lo in range(0, len(row), ENTRIES):
        r, part = row[lo : lo + ENTRIES], m[col[lo : lo + ENTRIES]] * value[lo : lo + ENTRIES, None]
        order = np.argsort(r, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(r[order]) > 0)))
        out[r[order][at]] += np.add.reduceat(part[order], at)
    return out


def _dense(row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows (whose entries are in order) as dense matrices in one place, some at a time."""
    step = max(1, min(rows, DENSE_CELLS // size))
    room = np.empty((step, size))
    for lo in range(0, rows, step):
        part, (a, b) = room[: min(step, rows - lo)], np.searchsorted(row, (lo, lo + step))
        part[:] = 0
        part[row[a:b] - lo, col[a:b]] = value[a:b]
        yield slice(lo, lo + len(part)), part


def _products(row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, m: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows' matrix A times m, and if asked for A'Am."""
    if len(row) * DENSE < rows * len(m):
        out = _times(row, col, value, m, rows)
        return out, _times(col, row, value, out, len(m)) if back else None
    out, squares = np.zeros((rows, m.shape[1])), np.zeros_like(m) if back else None
    for at, part in _dense(row, col, value, rows, len(m)):
        np.matmul(part, m, out=out[at])
        if back:
            squares += part.T @ out[at]
    return out, squares


@dataclass
class Svd:
    """Right singular vectors (columns by components) and singular values."""

    components: np.ndarray
    singular: np.ndarray

    def transform(self, df: DataFrame, vector: str = "vector", into: str = "embedding") -> DataFrame:
        """df with its rows' places along the components, an array of doubles; a null vector is at the origin."""
        sent = df.sparkSession.sparkContext.broadcast(self.components)
        rest = [c for c in df.columns if c != into]

        def run(batches):
            for b in batches:
                row, col, value = _sparse(b.select([len(rest)]))
                got = _products(row, col, value, b.num_rows, sent.value, False)[0]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(got), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], into])

        kept = df.select(*rest, F.unwrap_udt(vector).alias("_v")).drop(vector)
        rest.remove(vector)
        return kept.mapInArrow(run, T.StructType([*kept.drop("_v").schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def svd(df: DataFrame, k: int = 100, vector: str = "vector", more: int = 10, rounds: int = 4, seed: int = 7) -> Svd:
    """The k largest singular values of the rows' matrix and their right singular vectors, by randomised block iteration.

    A block of k + `more` random directions is multiplied by the matrix and its transpose, `rounds` times, and made orthonormal each time; it
    turns towards the largest singular vectors. Rows stay where they are and are dense only some at a time: a pass sends the block (columns times directions,
    at most MOST_CELLS numbers, so the columns must be hashed or chosen) to the tasks, and adds up what they make of it by ranges of
    columns. An empty table has singular values of zero."""
    spark = df.sparkSession
    rows = df.filter(F.col(vector).isNotNull()).select(F.unwrap_udt(vector).alias("v"))
    size = rows.agg(F.max(F.coalesce("v.size", F.size("v.values")))).first()[0] or 1
    width = min(k + more, size)
    if size * width > MOST_CELLS:
        raise ValueError(f"{size} columns times {width} directions are more than {MOST_CELLS} cells")
    rows = rows.coalesce(TASKS)

    def passed(block: np.ndarray, inner: bool) -> np.ndarray:
        """A'A times the block, or the block's own products B'A'AB."""
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            total = np.zeros((width if inner else size, width))
            for b in batches:
                row, col, value = _sparse(b)
                y, squares = _products(row, col, value, b.num_rows, sent.value, not inner)
                total += y.T @ y if inner else squares
            for lo in range(0, len(total), COLUMNS):
                part = total[lo : lo + COLUMNS].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([part], pa.list_(pa.float64()))], names=["lo", "x"])

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"lo": parts["lo"].iloc[:1], "x": [np.sum(np.stack(parts["x"].to_numpy()), axis=0)]})

        got = rows.mapInArrow(run, "lo int, x array<double>").groupBy("lo").applyInPandas(added, "lo int, x array<double>").collect()
        got.sort(key=lambda r: r.lo)
        sent.destroy()
        return np.concatenate([np.asarray(r.x) for r in got]).reshape(-1, width) if got else np.zeros((width if inner else size, width))

    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(passed(block, False))[0]
    squares, turn = np.linalg.eigh(passed(block, True))
    first = np.argsort(-squares)[: min(k, width)]
    return Svd(block @ turn[:, first], np.sqrt(np.maximum(squares[first], 0)))


def readout(train: DataFrame, rows: DataFrame, features: str = "vector", label: str = "label") -> DataFrame:
    """rows with `prediction`, the class that a multinomial logistic regression over train's vectors gives them."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=50, regParam=1e-3).fit(train).transform(rows).drop("rawPrediction", "probability")
