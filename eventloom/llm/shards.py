"""Shards of equal row counts whose mixture of sources follows the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

#: Rows that one sort group has on average. Groups are ranges of uniform hashes or of ranks, so none is much larger.
GROUP_ROWS = 20_000


def _numbered(df: DataFrame, by: list[str], part: str, order: list[str], out: str) -> DataFrame:
    """`out`: place, from 1, in the order of part and then `order` within equal `by`, without one task for all rows of a key."""
    sizes = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*by, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*by, part).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(here)).join(base, [*by, part]).withColumn(out, F.col("_base") + F.col("_k")).drop("_k", "_base")


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source and place of every row.

    Rows of a source are shuffled by a seeded hash of id and text and ranked; rank r of n gets the fraction (r - 1/2) / n. In the order of
    fractions over all sources, any run of rows has each source in proportion, and the order is cut into runs whose
    counts are at most one apart (law `rows`). Only ids, sizes and hashes are shuffled, in groups of about group_rows.
    A null source is a source, a null text has size 1; ties and repeated rows go in the order of id and then text hash;
    null ids come first. An empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.xxhash64(text).cast("string")), 256)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("source"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("draw"),
    )
    rows = stored(rows, "shard-keys")  # texts are read once
    total = rows.count()
    groups = max(1, -(-total // group_rows))
    span = -(-(1 << 60) // groups)
    rows = rows.withColumn("part", F.expr(f"draw div {span}"))
    ranked = _numbered(rows, ["source"], "part", ["draw", "doc_id", "text_crc32", "size"], "rank")
    of = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    ranked = ranked.join(of, "source").withColumn("fraction", (F.col("rank") * 2 - 1) / (F.col("of") * 2))
    ranked = ranked.withColumn("part", F.floor(F.col("fraction") * groups))
    placed = _numbered(ranked, [], "part", ["fraction", "draw", "source", "doc_id", "text_crc32", "size"], "place").withColumn("place", F.col("place") - 1)
    n = max(total, 1)
    cut = F.expr(f"(place * {shards}L) div {n}L")
    return placed.withColumn("shard", cut.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"), "place",
    )
