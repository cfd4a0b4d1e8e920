"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.llm import decontam, jaccard, linededup, packing, quality
from eventloom.llm.queries import vocabulary
from eventloom.llm.runtime import discard, stored, table, workers_see_package


def good_documents(spark, docs, sf_dir):
    """Documents that the quality classifier accepts (score >= 0.3), learnt from the labels of this corpus.

    Each row is judged by its whole text, however long, and repeated rows alike; a null text is an empty one, and ids do not matter for
    the score. Without labels every score is the same, and all rows stay or go. Columns of any name are kept; an empty table stays empty."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def fresh_lines(spark, docs, sf_dir):
    """Documents without lines of templates that recur in five documents; those that have nothing left go, n_chars follows the text.
    Equal long lines of two to four documents wait for clean_of_benchmarks: here they would cut near copies to pieces before the
    next stage can tell them.

    A null text, or one that was blank before, stays as it is; rows with the same id, null too, are one document, and equal rows lose the
    same lines, so that one of them keeps none of the first copies. Columns of any name are kept; an empty table stays empty."""
    workers_see_package(spark)
    return _left(linededup.dedup(docs, long_docs=5), docs)


def _left(out, docs):
    out = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark, docs, sf_dir):
    """The row with the smallest id of each group that links of similarity 0.8 on five-word shingles connect; of rows with
    equal id and text, one. Rows get a number each in a written table: each row of a repeated id is decided by itself. A null id
    is a value like any other, after all numbers; among texts of one id the smaller hash comes first. Null and blank texts link with
    nothing: all stay, save repeated rows. Columns of any name are kept; an empty table stays empty."""
    workers_see_package(spark)
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.join_documents(numbered, words=5, percent=80, id_col=row)
    found = stored(found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group"), F.col("n_shingles").alias("n")), "found")
    hashes = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    known = found.join(numbered.select(row, F.col("doc_id").alias("id"), *hashes), row)
    # A group is a component, or the equal rows of a blank text.
    blank = F.col("n") == 0
    same = [F.when(~blank, F.col("group")).alias("g"), *[F.when(blank, F.col(c)).alias(f"b_{c}") for c in ("id", "t1", "t2")], blank.alias("blank")]
    order = F.struct(F.col("id").isNull(), "id", "t1", "t2", row)
    first = stored(known.select(*same, order.alias("o"), F.col(row)).groupBy("g", "b_id", "b_t1", "b_t2", "blank").agg(F.min("o").alias("o")).select(F.col(f"o.{row}").alias(row)), "first")
    gone = stored(found.select(row).join(first, row, "left_anti"), "gone")
    discard(found, first)
    return numbered.join(linededup.sided(gone, 24), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def clean_of_benchmarks(spark, docs, sf_dir):
    """Documents without a passage like an item of the benchmark. Before that, of lines of 20 tokens or more that documents
    still share now that copies are gone, one stays (smallest id, null first, then place).

    A null or blank text has no passage and stays; repeated rows are decided alike; whole texts are searched, however long. Columns of
    any name are kept; an empty table of documents, or of benchmark items, takes nothing away."""
    workers_see_package(spark)
    docs = stored(_left(linededup.passages(docs), docs), "passages")
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark, docs, sf_dir):
    """Pieces of token sequences of at most 2048 ids: every row has one at least, a null or empty text that of its end id. Repeated rows
    and rows without id are packed each; other columns are not read; an empty table gives no rows."""
    workers_see_package(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmarks),
    ("packing", packed_sequences),
]

#: Models and token ids are beyond SQL; tests/llm compares each stage with a plain one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed corpus."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
