"""Rules over time series, each a window over one series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moves(df: DataFrame, by: list[str], day: str, value: str, percent: float) -> DataFrame:
    """Rows that moved by at least so many percent from the day before; after a gap there is no move."""
    w = Window.partitionBy(*by).orderBy(day)
    out = df.select("*", F.lag(value).over(w).alias("previous"), F.lag(day).over(w).alias("_day"))
    out = out.filter((F.datediff(day, "_day") == 1) & (F.col("previous") != 0)).withColumn("move_pct", (F.col(value) / F.col("previous") - 1) * 100)
    return out.filter(F.abs("move_pct") >= percent).drop("_day")


def drops(df: DataFrame, by: list[str], day: str, value: str, percent: float) -> DataFrame:
    """Falls of so many percent against yesterday and the day before that, which last two days more."""
    w = Window.partitionBy(*by).orderBy(day)
    out = df.select("*", F.lag(value, 1).over(w).alias("back1"), F.lag(value, 2).over(w).alias("back2"), F.lead(value, 2).over(w).alias("ahead2"))
    keep = 1 - percent / 100
    return out.filter((F.col(value) <= keep * F.col("back1")) & (F.col(value) <= keep * F.col("back2")) & (F.col("ahead2") <= keep * F.col("back1")))


def streaks(df: DataFrame, by: list[str], day: str, condition) -> DataFrame:
    """first_day, last_day, days of each unbroken run of rows for which the condition holds."""
    w = Window.partitionBy(*by).orderBy(day)
    marked = df.select(*by, day, F.coalesce(condition, F.lit(False)).alias("_c"))
    marked = marked.withColumn("_g", F.row_number().over(w) - F.sum(F.col("_c").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_c").groupBy(*by, "_g").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_g")


def carried(df: DataFrame, by: list[str], day: str, value: str, out: str) -> DataFrame:
    """The last value that is not null, up to the row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))


def change_points(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*by).orderBy(day)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def noisy(df: DataFrame, by: list[str], day: str, value: str, percent: float, days: int = 14, others: int = 3) -> DataFrame:
    """For each row, its move and whether at least `others` other moves of so many percent lie within `days` days."""
    w = Window.partitionBy(*by).orderBy(day)
    out = df.withColumn("move_pct", (F.col(value) / F.lag(value).over(w) - 1) * 100)
    big = (F.abs("move_pct") >= percent).cast("int")
    n = F.datediff(day, F.lit("1970-01-01"))
    around = Window.partitionBy(*by).orderBy(n).rangeBetween(-days, days)
    return out.withColumn("jumps", F.coalesce(F.sum(big).over(around), F.lit(0)) - F.coalesce(big, F.lit(0))).withColumn("noisy", F.col("jumps") >= others)


def level_moves(df: DataFrame, by: list[str], day: str, value: str, least: float, floor: float) -> DataFrame:
    """Rows that changed by `least` or more from the row before and stand at `floor` or above; `change` says by how much."""
    out = df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(day)))
    return out.filter((F.abs("change") >= least) & (F.col(value) >= floor))


def undone(df: DataFrame, by: list[str], day: str, value: str, percent: float = 20, near: float = 10, rows: int = 7) -> DataFrame:
    """Rows that moved by so many percent and one of whose next rows is back within `near` percent of the row before them."""
    w = Window.partitionBy(*by).orderBy(day)
    out = df.select("*", F.lag(value).over(w).alias("previous"), F.collect_list(value).over(w.rowsBetween(1, rows)).alias("_later")).filter(F.col("previous") != 0)
    back = F.exists("_later", lambda p: F.abs(p / F.col("previous") - 1) < near / 100)
    return out.filter((F.abs(F.col(value) / F.col("previous") - 1) * 100 >= percent) & back).drop("_later")
