"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

#: Queries whose vectors a task holds at once, rows of a block of dense scores, and cells of that block.
QUERY_BLOCK, CELLS = 2048, 4 << 20
SAFE = 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def weights(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and w = floor(scale * x) of each component; rows without id, or with a null or non-finite component, go."""
    x = F.col("v")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(good)
    return v.select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("w"))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(1)
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False), lens, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _terms(lens: np.ndarray) -> np.ndarray:
    return np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)


def accumulate(q: tuple, c: tuple) -> np.ndarray:
    """Scores of queries against candidates, one term after another: the term's postings, weighted, go into dense arrays."""
    _, qlens, qvals = q
    _, clens, cvals = c
    most = int(np.abs(qvals).max(initial=0)) * int(np.abs(cvals).max(initial=0)) * int(min(qlens.max(initial=0), clens.max(initial=0)))
    kind = np.int64 if most < SAFE else object
    scores = np.zeros((len(qlens), len(clens)), kind)
    ct, crow, qt, qrow = _terms(clens), np.repeat(np.arange(len(clens)), clens), _terms(qlens), np.repeat(np.arange(len(qlens)), qlens)
    for t in range(int(min(qlens.max(initial=0), clens.max(initial=0)))):
        p = np.flatnonzero((ct == t) & (cvals != 0)) if (clens != clens[0]).any() else t + np.flatnonzero(cvals[t :: clens[0]]) * clens[0]
        s = np.flatnonzero((qt == t) & (qvals != 0))
        if len(p) and len(s):
            rows, w = crow[p], cvals[p].astype(kind)
            if len(rows) == len(clens):
                for i, x in zip(qrow[s].tolist(), qvals[s].tolist(), strict=True):
                    scores[i] += x * w
            else:
                for i, x in zip(qrow[s].tolist(), qvals[s].tolist(), strict=True):
                    scores[i, rows] += x * w
    return scores


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    return ids[order[:k]], scores[order[:k]]


def search(df: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`.

    Queries are rows of a sparse matrix of integer weights; they are taken in blocks of at most query_block, read by hash of
    the id, so that what is sent to the tasks has a fixed bound. Each task scores its rows against a block in dense arrays,
    keeps k of each query (partition selection), and the partial lists are merged. A vector with fewer components has zeros
    after them. Rows with the query's own id are never its answers, repeated rows included. Scores beyond a long are cut to its range.
    Null or empty tables give no rows; an empty vector scores 0.
    """
    all_rows = weights(df, id_col, vector_col, scale)
    asked = all_rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() * 5 // (query_block * 4)))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        got = asked.filter(F.col("b") == b).select("vec_id", "w").toArrow().combine_chunks()
        batches = got.to_batches()
        q = _rows(batches[0]) if batches else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        part, sent = _against(all_rows, q, k)
        if blocks > 1:  # a block's partial lists are written and what was sent for it is released before the next
            part = stored(part, "topk")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(rows: DataFrame, q: tuple, k: int) -> tuple[DataFrame, Broadcast]:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(q)

    def run(batches):
        q = sent.value
        if not len(q[0]):
            return
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q[0])
        step = max(1, CELLS // len(q[0]))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                c = _rows(batch.slice(lo, step))
                scores = accumulate(q, c)
                for i, own in enumerate(q[0].tolist()):
                    ids, s = best(c[0], scores[i], k + 1)
                    if (ids == own).any():
                        other = c[0] != own
                        ids, s = best(c[0][other], scores[i][other], k)
                    top[i] = best(np.concatenate((top[i][0], ids)), np.concatenate((top[i][1], s)), k)
        n = [len(ids) for ids, _ in top]
        if sum(n):
            s = np.concatenate([s for _, s in top])
            s = s if s.dtype != object else [min(MOST, max(LEAST, x)) for x in s.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[0], n)), pa.array(np.concatenate([i for i, _ in top])), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long"), sent
