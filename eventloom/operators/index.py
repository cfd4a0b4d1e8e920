"""The archive's word index: which months and feeds have a word, written once beside the items, and searches that read only those partitions.

    items/month=2024-03/feed=quakes/...     the items
    words/shard=17/...                      word, month, feed: once each, ordered by word; a shard holds all words of some first letters
    places/...                              month, feed, items
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import catalog, search

SHARDS = 64
#: Parts of a shard when it is written, and words that a task holds before it sends them on.
PARTS, HELD = 8, 1 << 20
#: Months of a word that is rare enough to look a question up by, and months that are read for it.
RARE_MONTHS, MOST_MONTHS = 60, 12
#: A word in more months than the first and no more than the second is also known by feed.
BY_FEED = (12, 120)


def shard_of(start: str) -> int:
    return zlib.crc32(start[:2].encode()) % SHARDS


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each feed and month, by shard and the hash of three letters, in lists; of what a task has, HELD words at a time."""
    held, many = {}, 0

    def flush():
        for (month, feed), found in held.items():
            words = pa.concat_arrays(found).unique()
            start = pc.utf8_slice_codeunits(words, 0, 3).dictionary_encode()
            code = np.array([shard_of(x) * PARTS + zlib.crc32(x.encode()) % PARTS for x in start.dictionary.to_pylist()], np.int64)[start.indices.to_numpy()]
            order = np.argsort(code, kind="stable")
            codes, first = np.unique(code[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), words.take(pa.array(order)))
            cols = [pa.array(codes // PARTS, pa.int32()), pa.array(codes % PARTS, pa.int32()), *[pa.array([x] * len(codes), pa.string()) for x in (month, feed)], lists]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "part", "month", "feed", "words"])
        held.clear()

    for b in batches:
        places = {}
        for i, place in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            places.setdefault(place, []).append(i)
        for place, at in places.items():
            words = b.column(2).take(pa.array(at)).flatten().unique()
            if len(words):
                held.setdefault(place, []).append(words)
                many += len(words)
        if many > HELD:
            yield from flush()
            many = 0
    yield from flush()


def write(items: DataFrame, path: str, text: tuple[str, ...] = ("title", "summary")) -> None:
    """Write items (feed, month and the columns of `text` among theirs) and their index. A task makes its words distinct, as lists by feed,
    month and shard, which are shuffled once; a large shard is dealt over several tasks by its words' third letters."""
    catalog.write(items, f"{path}/items")
    stored = catalog.read(items.sparkSession, f"{path}/items")
    lists = catalog.tokens(stored, F.concat_ws("\n", *text)).mapInArrow(_lists, "shard int, part int, month string, feed string, words array<string>")
    words = lists.repartition("shard", "part").select("shard", "part", "month", "feed", F.explode("words").alias("word"))
    rows = words.withColumn("word", X.stem(F.col("word"))).distinct().select("word", "month", "feed", "shard")  # a stem has its word's first letters
    rows = rows.sortWithinPartitions("shard", "word")
    rows.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/words")
    stored.groupBy("month", "feed").agg(F.count(F.lit(1)).alias("items")).write.mode("overwrite").parquet(f"{path}/places")


def _may_have(word: Column, form: str) -> Column:
    """Whether a word whose stem this is may begin with the form: a stem is the start of its word and lacks three letters at most."""
    return word.startswith(form) | (F.lit(form).startswith(word) & (F.length(word) >= len(form) - 3))


def _starts(form: str) -> str | None:
    """The first word of a form, if the index can have it: over two letters, a digit not alone, nothing that parts words before its third letter."""
    first = form.lower().split(" ")[0]
    start = first
    for i, c in enumerate(first):
        if not (c.isalnum() or c in "_'"):
            start = first[:i]
            break
    return start if len(start) > 2 and not start.isdigit() else None


def _hits(spark: SparkSession, path: str, words: list[str]) -> tuple[DataFrame, list[int]]:
    """w, word, month, feed of stems that may stand for the question's word w, from the shards of their first letters alone; and which words
    the index can look up. Of the others nothing is known."""
    found, known = [], []
    table = spark.read.parquet(f"{path}/words")
    for w, word in enumerate(words):
        starts = [_starts(f) for f in search.forms(word)] if word.isascii() else [None]
        if None not in starts:
            known.append(w)
            rows = table.filter(F.col("shard").isin(sorted({shard_of(s) for s in starts})) & reduce(Column.__or__, [_may_have(F.col("word"), s) for s in starts]))
            found.append(rows.select(F.lit(w).alias("w"), "word", "month", "feed"))
    return reduce(DataFrame.unionByName, found) if found else table.limit(0).select(F.lit(0).alias("w"), "word", "month", "feed"), known


def _named(word: str) -> Column:
    return search.has(word, F.replace(F.col("feed"), F.lit("-"), F.lit(" ")))


def places(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """month, feed of all partitions that can have an item with every word: it stands there, or the feed is named by it."""
    hits, known = _hits(spark, path, words)
    per = hits.groupBy("month", "feed").agg(F.collect_set("w").alias("ws"))
    whole = spark.read.parquet(f"{path}/places").join(per, ["month", "feed"], "left")
    tests = [F.coalesce(F.array_contains("ws", w), F.lit(False)) | _named(words[w]) for w in known]
    return whole.filter(reduce(Column.__and__, tests, F.lit(True))).select("month", "feed")


def months(spark: SparkSession, path: str, words: list[str], rare: int = RARE_MONTHS, most: int = MOST_MONTHS, by_feed: tuple[int, int] = BY_FEED) -> DataFrame:
    """month, words (how many of the question's stand there): the months to read for a question without a date, at most `most`.

    Sets of months may decide: those of a word in one feed that the question names (if it has fewer there than elsewhere, and between `by_feed`),
    those of a rare word, and, only where there is neither, those that have every word. The smallest does; of equal ones a word in a feed
    goes first, then the earlier word. Its months with more of the words come first, then newer ones. All is one plan over the rows
    of the asked words; no word is gathered."""
    hits, _ = _hits(spark, path, words)
    stems = {w: sorted({search.stem(f) for f in search.forms(word)}) for w, word in enumerate(words)}
    exact = reduce(Column.__or__, [(F.col("w") == w) & F.col("word").isin(s) for w, s in stems.items()])
    own_form = reduce(Column.__or__, [(F.col("w") == w) & (F.col("word") == search.stem(word)) for w, word in enumerate(words)])
    named = reduce(Column.__or__, [_named(w) for w in words])
    rows = hits.filter(exact).withColumn("own", own_form & named).groupBy("w", "month").agg(F.collect_set(F.when(F.col("own"), F.col("feed"))).alias("feeds"), F.max("own").alias("_"))
    # For each month, the sets that it belongs to: of each word, of each word in a named feed, and of all words together.
    per = rows.groupBy("month").agg(F.count(F.lit(1)).cast("int").alias("words"), F.collect_list(F.struct("w", "feeds")).alias("ws"))
    none = F.lit(None).cast("string")
    one = lambda kind, w, feed: F.struct(F.lit(kind).alias("kind"), w.cast("int").alias("w"), feed.alias("feed"))
    of_words, in_feeds = F.transform("ws", lambda x: one(1, x["w"], none)), F.flatten(F.transform("ws", lambda x: F.transform(x["feeds"], lambda f: one(0, x["w"], f))))
    together = F.when((F.col("words") == len(words)) & F.lit(len(words) > 1), F.array(one(2, F.lit(-1), none))).otherwise(F.array().cast("array<struct<kind: int, w: int, feed: string>>"))
    sets = per.select("month", "words", F.explode(F.concat(of_words, in_feeds, together)).alias("s")).select("month", "words", "s.*")
    sets = sets.groupBy("kind", "w", "feed").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("words", "month")).alias("months"))  # months of the archive at most
    sets = sets.withColumn("of", F.max(F.when(F.col("kind") == 1, F.col("n"))).over(Window.partitionBy("w")))
    may = F.when(F.col("kind") == 1, F.col("n") <= rare).when(F.col("kind") == 0, F.col("of").between(by_feed[0] + 1, by_feed[1]) & (F.col("n") < F.col("of"))).otherwise(True)
    least = sets.filter(may).agg(F.min(F.struct((F.col("kind") == 2).alias("last"), "n", "kind", "w", "feed", "months")).alias("a"))
    return least.select(F.explode(F.slice(F.sort_array("a.months", asc=False), 1, most)).alias("m")).select("m.month", "m.words")


def find(spark: SparkSession, path: str, words: list[str], since: str | None = None, until: str | None = None, feeds: list[str] | None = None, rare: int = RARE_MONTHS, most: int = MOST_MONTHS) -> DataFrame:
    """Items that have every word in title, summary or feed name; in the months from since to until, or those that months() names if neither is given.

    Which partitions are read is decided in the plan: the chosen places, one row at most for each partition of the archive, are sent to the
    scan, which opens no other. No item of the period is lost by that, as a stem is the start of its word."""
    where = places(spark, path, words)
    if since or until:
        where = where.filter((F.col("month") >= (since or "0")[:7]) & (F.col("month") <= (until or "9")[:7]))
    else:
        where = where.join(F.broadcast(months(spark, path, words, rare, most).select("month")), "month", "left_semi")
    where = where.filter(F.col("feed").isin(feeds)) if feeds else where
    found = catalog.read(spark, f"{path}/items").join(F.broadcast(where), ["month", "feed"], "left_semi")
    found = search.find(found, words)
    for on, test in ((since, F.col("date") >= (since or "")), (until, F.substring("date", 1, len(until or "")) <= (until or ""))):
        found = found.filter(test) if on else found
    return found
