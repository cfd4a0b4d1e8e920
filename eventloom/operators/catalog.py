"""The archive: items by month and feed, upserted by key, with its word index, day counts and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def with_keys(items: DataFrame, now: str = "1970-01") -> DataFrame:
    """Items with their key and month (that of `now` if the date is not well formed)."""
    month = F.when(F.col("date").rlike(r"^\d{4}-(0[1-9]|1[0-2])"), F.substring("date", 1, 7)).otherwise(F.lit(now[:7]))
    return items.withColumn("key", X.item_key(F.col("feed"), F.col("link"), F.col("title"))).withColumn("month", month)


def upsert(archive: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """The archive and, of the fresh items, the first of each key that its month lacks."""
    rest = [c for c in archive.columns if c not in ("month", "key")]
    new = fresh.groupBy("month", "key").agg(F.min(F.struct(*order, F.struct(*rest).alias("_r"))).alias("_f")).select("month", "key", "_f._r.*")
    return archive.unionByName(new.join(archive.select("month", "key"), ["month", "key"], "left_anti").select(*archive.columns))


def write(items: DataFrame, path: str) -> None:
    """One folder for each month and feed, so that a question reads only those that it asks for. Spark deals a feed's month over
    several tasks where it is large, as one may hold most rows, and gives several small ones to one."""
    items.hint("rebalance", "month", "feed").write.mode("overwrite").partitionBy("month", "feed").parquet(path)


def read(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, feeds: list[str] | None = None) -> DataFrame:
    found = spark.read.option("basePath", path)
    own = found.parquet(path).schema
    df = found.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("month", "feed") else f for f in own])).parquet(path)  # no feed's name is a number
    for on, test in ((since, F.col("month") >= (since or "")[:7]), (until, F.col("month") <= (until or "")[:7])):
        df = df.filter(test) if on else df
    return df.filter(F.col("feed").isin(feeds)) if feeds else df


def month_counts(items: DataFrame) -> DataFrame:
    """Items of each month and feed, and of each month (feed null)."""
    both = items.groupBy("month", "feed").agg(F.count(F.lit(1)).alias("items"))
    return both.unionByName(both.groupBy("month").agg(F.sum("items").alias("items")).withColumn("feed", F.lit(None).cast("string")))


def day_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(F.substring("date", 1, 10).alias("day"), "feed").agg(F.count(F.lit(1)).alias("items"))


def tokens(items: DataFrame, text: Column) -> DataFrame:
    """month, feed, words: the distinct words of each item that have a stem: over two letters, no numbers."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)[\w']+)"), 1))
    return items.select("month", "feed", F.filter(found, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$")).alias("words"))


def stems(items: DataFrame, text: Column) -> DataFrame:
    """feed, month, word: each stem (see text.words) once for each feed and month. Words are made distinct before their stems are taken."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)[\w']+)"), 1))
    tokens = items.select("feed", "month", F.explode(tokens).alias("word")).filter((F.length("word") > 2) & ~F.col("word").rlike(r"^\d+$")).distinct()
    return tokens.select("feed", "month", X.stem(F.col("word")).alias("word")).distinct()


def postings(items: DataFrame, text: Column | None = None) -> DataFrame:
    """word, feed, months: in which months each stem stands in a feed's titles, or another text. Distinct pairs are made before anything is gathered."""
    single = stems(items, F.col("title") if text is None else text)
    return single.groupBy("word", "feed").agg(F.array_sort(F.collect_set("month")).alias("months"))


def index(posted: DataFrame, common: int = 12, most: int = 120) -> DataFrame:
    """word, shard, months over all feeds, kind: common words (more than `common` months, at most `most`) are also kept by feed."""
    whole = posted.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"))
    n = F.size("months")
    return whole.withColumn("kind", F.when(n > most, "everywhere").when(n > common, "by feed").otherwise("whole")).withColumn("shard", F.substring("word", 1, 2))


def latest(items: DataFrame, n: int = 30, tie: str = "key") -> DataFrame:
    """The newest n of each feed."""
    w = Window.partitionBy("feed").orderBy(F.desc("date"), F.asc(tie))
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def on_this_day(items: DataFrame, least: float, n: int = 60) -> DataFrame:
    """Items that are big enough, newest first within their day of the year."""
    w = Window.partitionBy("day").orderBy(F.desc("date"), "key")
    return items.filter(F.col("size") >= least).withColumn("day", F.substring("date", 6, 5)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# Checks -------------------------------------------------------------------------------------------------------------


def duplicate_keys(items: DataFrame) -> DataFrame:
    return items.groupBy("month", "key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def odd_dates(items: DataFrame, today: str) -> DataFrame:
    """Dates before 1800, over two days ahead, or 1970-01-01, which a missing time becomes."""
    late = F.date_format(F.date_add(F.lit(today).cast("date"), 2), "yyyy-MM-dd")
    why = F.when(F.col("date") < "1800", "before 1800").when(F.substring("date", 1, 10) > late, "ahead").when(F.col("date").rlike(r"^1970-01-01(T\d\d:00:00Z?)?$"), "epoch")
    return items.withColumn("why", why).filter("why is not null")


def misplaced(items: DataFrame) -> DataFrame:
    return items.filter(F.substring("date", 1, 7) != F.col("month"))


def quiet_feeds(items: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Feeds whose newest item is so many days old."""
    last = items.groupBy("feed").agg(F.max(F.substring("date", 1, 10)).alias("newest"))
    return last.withColumn("days", F.datediff(F.lit(today).cast("date"), F.col("newest").cast("date"))).filter(F.col("days") >= days)


def health(runs: DataFrame) -> DataFrame:
    """feed, status, since: the status of each feed's last run (ok, empty or failing) and when it began."""
    status = F.when(F.col("failed"), "failing").when(F.col("items") == 0, "empty").otherwise("ok")
    w = Window.partitionBy("feed").orderBy("run")
    s = runs.withColumn("status", status).withColumn("turn", F.lag("status").over(w))
    begun = s.filter(F.col("turn").isNull() | (F.col("turn") != F.col("status")))
    return begun.groupBy("feed").agg(F.max_by("status", "run").alias("status"), F.max("run").alias("since"))


def stable_keys(first: DataFrame, second: DataFrame, most: float = 0.2) -> DataFrame:
    """fresh, whole, unstable: how many keys of a second run the first lacked; over a fifth means that keys change."""
    fresh = second.select("key").distinct().join(first.select("key").distinct(), "key", "left_anti").agg(F.count(F.lit(1)).alias("fresh"))
    return fresh.join(F.broadcast(second.agg(F.countDistinct("key").alias("whole")))).withColumn("unstable", F.col("fresh") > F.col("whole") * most)


def splice(live: DataFrame, history: DataFrame, by: str = "feed", date: str = "date") -> DataFrame:
    """The live rows, and those of a history that are older than the oldest live one of their feed."""
    oldest = live.groupBy(by).agg(F.min(date).alias("_oldest"))
    older = history.join(oldest, by, "left").filter(F.col("_oldest").isNull() | (F.col(date) < F.col("_oldest")))
    return live.unionByName(older.drop("_oldest"))


def fullest(reports: DataFrame, by: str, detail, order: str) -> DataFrame:
    """One report for each id: the last that has the detail, else the first: one without never replaces another."""
    has, n = F.coalesce(detail, F.lit(False)), F.col(order).cast("long")
    rank = F.struct(has.cast("int"), F.when(has, n).otherwise(-n))
    return reports.groupBy(by).agg(F.max_by(F.struct(*[c for c in reports.columns if c != by]), rank).alias("_r")).select(by, "_r.*")


def recent_days(items: DataFrame, last: str, days: int, by: str = "feed") -> DataFrame:
    """day, feed, items for each of the last days and each feed, days without items too."""
    spine = items.select(by).distinct().withColumn("day", F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))))
    spine = spine.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    counted = day_counts(items.withColumnRenamed(by, "feed")).withColumnRenamed("feed", by)
    return spine.join(counted, ["day", by], "left").fillna(0, ["items"])


def pass_rates(answers: DataFrame, by: list[str], ok) -> DataFrame:
    """passed, of, share of each group of graded answers."""
    return answers.groupBy(*by).agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("of"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("share"))
