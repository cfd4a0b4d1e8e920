"""Joins that Spark has no word for: as-of, range, first of a key, mirrored legs, and greedy clusters in space and time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, tolerance: int, forward: bool = False, out: str = "value") -> DataFrame:
    """Left rows with the value of the last right row at or before their time (forward: the first at or after), up to
    `tolerance` seconds away, else null. Both sides go through one sorted window of a key and time slice, and a row looks at
    its own slice and the one beside it, so a key with a third of all rows is split by time."""
    sign = 1 if forward else -1
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slice_ = lambda c: F.floor(c / (tolerance * 1e6 + 1))
    l = left.withColumn("_t", t(left_time)).withColumn("_id", F.monotonically_increasing_id())  # noqa: E741
    r = right.select(*by, t(right_time).alias("_rt"), F.col(value).alias("_v"))
    here = r.withColumn("_s", slice_(F.col("_rt")))
    beside = here.withColumn("_s", F.col("_s") - sign)
    l = l.withColumn("_s", slice_(F.col("_t")))  # noqa: E741
    cols = left.columns
    both = l.select(*by, "_s", "_t", F.lit(1 if not forward else 0).alias("_k"), F.struct("_id", *cols).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("long").alias("_rt")).unionByName(
        here.unionByName(beside).select(*by, "_s", F.col("_rt").alias("_t"), F.lit(0 if not forward else 1).alias("_k"), F.lit(None).cast(l.select(F.struct("_id", *cols)).schema[0].dataType).alias("_l"), "_v", "_rt")
    )
    w = Window.partitionBy(*by, "_s").orderBy(F.col("_t"), F.col("_k"))
    w = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if forward else F.last
    got = both.select("*", pick(F.when(F.col("_l").isNull(), F.struct("_rt", "_v")), ignorenulls=True).over(w).alias("_m")).filter("_l is not null")
    near = F.abs(F.col("_m._rt") - F.col("_t")) <= tolerance * 1_000_000
    return got.select("_l.*", F.when(near, F.col("_m._v")).alias(out)).drop("_id")


def near_in_time(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int, on: list[str]) -> DataFrame:
    """All pairs with equal `on` and at most so many seconds between them: an equi join on time slices and their neighbours."""
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = left.withColumn("_lt", t(left_time)).withColumn("_s", F.explode(F.array(*[F.floor(F.col("_lt") / (seconds * 1e6)) + i for i in (-1, 0, 1)])))  # noqa: E741
    r = right.withColumn("_rt", t(right_time)).withColumn("_s", F.floor(F.col("_rt") / (seconds * 1e6)))
    return l.join(r, [*on, "_s"]).filter(F.abs(F.col("_lt") - F.col("_rt")) <= seconds * 1_000_000).drop("_s", "_lt", "_rt")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, kept before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min(F.struct(*order, F.struct(*rest).alias("_r"))).alias("_f")).select(*by, "_f._r.*")


def without_mirrors(df: DataFrame, same: list[str], a: str, b: str) -> DataFrame:
    """Rows without a counterpart that has `same` equal and a and b swapped."""
    legs = df.select(*same, F.col(a).alias(b), F.col(b).alias(a)).distinct()
    return df.join(legs, [*same, a, b], "left_anti")


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def clusters(reports: DataFrame, seconds: float = 120, reach_km: float = 400, priority: str = "priority", span: float = 21600) -> DataFrame:
    """Each report with `cluster`, the id of the report that opened its cluster: in the order of priority, time and id, a report
    joins the first cluster whose opener is within the seconds and kilometres, or opens one.

    A report opens one if, and only if, no near report before it does; only one set of openers fits that, so it may be found piece by piece. A task gets
    a span of time and what lies within the seconds around it; what it assumes of these is what their own task found in the round
    before. Rounds go on until none changes, mostly three or four, over the spans beside a change alone. No task holds more than a span, however dense the stream; for one
    that is denser than a task can hold, give a shorter span. Ids are unique; an empty table stays empty."""
    if span < seconds:
        raise ValueError("span must be no shorter than seconds")
    cols, id_type = reports.columns, reports.schema["id"].dataType.simpleString()
    slim = reports.select("id", F.col("t").cast("double").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(priority).alias("p"))
    own = F.floor(F.col("t") / span).cast("long")
    known = slim.withColumns({"b": own, "opens": F.lit(True), "cluster": F.col("id")})

    schema = f"id {id_type}, t double, lat double, lon double, p {slim.schema['p'].dataType.simpleString()}, b long, opens boolean, cluster {id_type}, changed boolean"
    near = F.array_distinct(F.array(F.col("b"), F.floor((F.col("t") - seconds) / span).cast("long"), F.floor((F.col("t") + seconds) / span).cast("long")))
    again = None
    while True:
        rows, rest = known.withColumn("g", F.explode(near)), None
        if again is not None:  # only spans that have assumed what has changed; there are few spans
            rows, rest = rows.join(F.broadcast(again), "g", "left_semi"), known.join(F.broadcast(again), F.col("b") == F.col("g"), "left_anti").withColumn("changed", F.lit(False))
        done = rows.groupBy("g").applyInPandas(lambda group: _settle(group, seconds, reach_km), schema)
        known = shared(done if rest is None else done.unionByName(rest))
        again = shared(known.filter("changed").withColumn("g", F.explode(near)).filter("g <> b").select("g").distinct())
        known = known.drop("changed")
        if again.isEmpty():
            break
    return reports.join(known.select(F.col("id").alias("_id"), "cluster"), F.col("id") == F.col("_id")).select(*cols, "cluster")


def _settle(group: pd.DataFrame, seconds: float, reach_km: float) -> pd.DataFrame:
    """The reports of span `g`, each with what it opens or joins, given what those around it open."""
    side = max(reach_km * (1 + 1e-9), 1.0)  # of a cell: a straight line is no longer than the way over the ground
    wide = 2 * int(6371 / side) + 5
    beside = [((s * wide + x) * wide + y) * wide + z for s in (-1, 0, 1) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    block = int(group["g"].iloc[0])
    group = group.sort_values(["p", "t", "id"], kind="stable").reset_index(drop=True)
    # Openers by slice of time and cell of space: one that is near is in a report's own or in one beside it.
    la, lo = (np.radians(np.nan_to_num(group[c].to_numpy(float))) for c in ("lat", "lon"))
    slot = np.floor(group["t"].to_numpy() / seconds)
    cell = (slot - slot.min()).astype(np.int64)
    for x in (np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)):
        cell = cell * wide + np.floor(6371 * x / side).astype(np.int64) + wide // 2
    heads: dict[int, list[tuple]] = {}
    opens, cluster = group["opens"].to_numpy().copy(), group["cluster"].to_numpy(object).copy()
    for n, (key, t, lat, lon, b, c) in enumerate(zip(group["id"].tolist(), group["t"].tolist(), group["lat"].tolist(), group["lon"].tolist(), group["b"].tolist(), cell.tolist(), strict=True)):
        if b == block:
            first = None
            for o in beside:
                for h in heads.get(c + o, ()):  # in order
                    if first is not None and h[0] > first[0]:
                        break
                    if abs(h[2] - t) <= seconds and ((h[3] == lat and h[4] == lon) or _km(h[3], h[4], lat, lon) <= reach_km):
                        first = h
                        break
            opens[n], cluster[n] = first is None, key if first is None else first[1]
        if opens[n]:
            heads.setdefault(c, []).append((n, key, t, lat, lon))
    changed = (opens != group["opens"].to_numpy()) | (cluster != group["cluster"].to_numpy(object))
    return group.assign(opens=opens, cluster=pd.Series(cluster, dtype=group["cluster"].dtype), changed=changed)[group["b"] == block][["id", "t", "lat", "lon", "p", "b", "opens", "cluster", "changed"]]


def shared(df: DataFrame) -> DataFrame:
    """The rows from the folder that the cluster shares for checkpoints, so that a round does not go back to all before it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return df.checkpoint()


def _km(la1: float, lo1: float, la2: float, lo2: float) -> float:
    la1, lo1, la2, lo2 = map(math.radians, (la1, lo1, la2, lo2))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))
