"""Ranked lexical search: integer scores of a set of items over postings that are bucketed by term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import stored

#: Pairs of an item and a term that are taken at once (what is sent to all tasks is bounded by them), and buckets of terms.
PAIRS, BUCKETS = 1 << 18, 64


def _tokens(texts: pa.Array):
    """Runs of rows: first row, end row, terms, offsets of the rows' terms."""
    data, offs = tk.flat(texts)
    for lo, hi, d, o in tk.slices(data, offs):
        yield (lo, hi, *tk.words(d, o, apart=tk.MARKS))


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item; rows with the same id, null too, are one item."""

    def run(batches):
        for b in batches:
            for lo, hi, w, bounds in _tokens(b.column(1)):
                rows = np.repeat(np.arange(lo, hi), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), w.cast(pa.large_string()).cast(pa.string())], names=["item_id", "term"])

    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, term (its number in `terms`), row, doc_id, n, tf of each asked term in each row of docs, sorted by bucket and term in each partition.
    Rows of bucket -1 count documents (tf) and terms (n) of what was read. Rows are told apart by a number, as ids may repeat."""
    asked = docs.sparkSession.sparkContext.broadcast(terms)
    names = ["bucket", "term", "row", "doc_id", "n", "tf"]

    def run(batches):
        known = pa.array([t.encode() for t in asked.value], pa.large_binary())
        for b in batches:
            ids, marks = b.column(0), b.column(1)
            for lo, hi, w, bounds in _tokens(b.column(2)):
                n = np.diff(bounds)
                coded = w.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(w) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(hi - lo), n)[term >= 0]
                key, tf = np.unique(term[term >= 0] * (hi - lo) + row, return_counts=True)
                term, row = np.divmod(key, hi - lo)
                at = pa.array(row + lo)
                cols = [pa.array(term % buckets, pa.int32()), pa.array(term, pa.int32()), marks.take(at), ids.take(at), pa.array(n[row]), pa.array(tf.astype(np.int64))]
                whole = [-1, -1, None, None, int(n.sum()), int((n > 0).sum())]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.array([x], c.type)]) for c, x in zip(cols, whole, strict=True)], names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket int, term int, row long, doc_id long, n long, tf long").sortWithinPartitions("bucket", "term")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k rows of docs that score highest for each item, above 0, equal scores by ascending id (null last).

    A term is a run of ASCII letters (A-Z in lower case), digits and characters beyond ASCII. Weights are floor(1000 * ln((2N + 2) / (2df + 1))) and
    scores the sums of weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, in 64-bit integers, over an item's distinct terms.
    N, L and df are counted over all rows. The asked terms, not all, have postings, which are written once; each row's postings then meet in one
    task (a shuffle of postings, not of matches), so that the sums by item and row need no other shuffle, and each task passes on k rows an
    item. A text's postings are at most the asked terms, so no word or text makes a large group.

    Items are taken in blocks of about `pairs` item-term pairs, each block over all rows. Items with the same id are one; a null id is
    an id. Rows with the same doc_id are documents of their own, ranked each. A null or empty text has no terms. Other columns are
    ignored; empty tables give no rows."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = -(-wanted.count() // pairs) or 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    out = None
    for b in range(blocks):
        part = _best(docs, wanted.filter(block == b), k, id_col, text_col)
        part = stored(part, "ranked") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _best(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    pairs = wanted.toArrow()  # one block of a stated set
    terms = sorted(pc.unique(pairs["term"]).to_pylist())
    posted = stored(postings(docs, terms, id_col, text_col), "postings")
    n_docs, n_terms = posted.filter("bucket = -1").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).first()
    real = posted.filter("bucket >= 0")
    df = real.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    number = spark.createDataFrame(pa.table({"item_id": pairs["item_id"], "term": pc.index_in(pairs["term"], value_set=pa.array(terms, pairs["term"].type))}), "item_id long, term int")
    weighted = number.join(F.broadcast(df.select("term", weight.alias("w")).filter("w > 0")), "term")
    impact = F.expr(f"(1000000000L * tf) div (1000L * tf + 20L * (50L + (50L * n * {n_docs}L) div {n_terms}L))")
    scored = real.select("row", "term", "doc_id", impact.alias("u")).repartition("row").join(F.broadcast(weighted), "term")
    sums = scored.groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("u")).alias("score")).filter("score > 0")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM t),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, docs),
u AS (SELECT p.r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * docs) // terms)) AS impact FROM p JOIN t USING (r), c),
s AS (SELECT item_id, r, doc_id, sum(weight * impact)::BIGINT AS score FROM i JOIN f USING (term) JOIN u USING (term) GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
