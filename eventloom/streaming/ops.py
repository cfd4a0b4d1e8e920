"""The event algebra over streams: watermarks close windows, state is keyed and bounded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import State


def counts(df: DataFrame, by: str, every: str, late: str = "0 seconds", time: str = "ts", distinct: str | None = None, approximate: bool = False) -> DataFrame:
    """window_start, value, count of closed windows; what comes after a window has closed is dropped (and in Spark's metrics).

    distinct: count the different values of a column, which the state of an open window holds; approximate: a sketch of them instead."""
    w = F.window(F.col(time), every)
    rows = df.withWatermark(time, late).filter(F.col(by).isNotNull() & (F.col(by).cast("string") != ""))
    if distinct and not approximate:
        rows = rows.select(w.alias("window"), by, distinct).dropDuplicates(["window", by, distinct])
        w = F.col("window")
    how = F.approx_count_distinct(distinct) if distinct and approximate else F.count(distinct or F.lit(1))
    return rows.groupBy(w, F.col(by).cast("string").alias("value")).agg(how.alias("count")).select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("window_start"), "value", "count")


def dedupe(df: DataFrame, *by: str, time: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first row of each identity within a span of event time; the state forgets older ones."""
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark(list(by))


def recent(df: DataFrame, key: str, window: int) -> DataFrame:
    """Rows whose key is not among the last `window` different keys of its group (a hash of the key): the bounded memory of
    what was seen, most recent last. State is one list for each of 64 groups."""
    schema, cols = df.schema, df.columns
    each = max(1, window // 64)

    def step(_, parts, state):
        seen = dict.fromkeys(state.get[0]) if state.exists else {}
        for part in parts:
            keep = []
            for k in part[key].astype(str):
                keep.append(k not in seen)
                seen.pop(k, None)
                seen[k] = None
                if len(seen) > each:
                    del seen[next(iter(seen))]
            yield part[cols][pd.Series(keep, index=part.index)]
        state.update((list(seen),))

    group = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(64))
    return df.groupBy(group.alias("_g")).applyInPandasWithState(step, schema, "seen array<string>", "append", "NoTimeout")


def keyed_changes(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, change, fields of added and modified rows, as texts. The state is one row of texts for each key; nothing else is read or
    written. Of several rows of a key in a batch the greatest counts."""
    kind = df.schema[key].dataType.simpleString()

    def step(k, parts, state):
        rows = [tuple(None if pd.isna(x) else x for x in r) for part in parts for r in part[list(fields)].itertuples(index=False)]
        now = max(rows, key=lambda r: [(x is not None, x or "") for x in r])
        old = tuple(state.get[0]) if state.exists else None
        state.update((list(now),))
        changed = [{"path": f, "old": a, "new": b} for f, a, b in zip(fields, old or now, now, strict=True) if a != b]
        if old is None or changed:
            yield pd.DataFrame({key: [k[0]], "change": ["modified" if changed else "added"], "fields": [changed or None]})

    rows = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, change string, fields array<struct<path:string,old:string,new:string>>", "seen array<string>", "append", "NoTimeout")


def pending(df: DataFrame, key: str, value: str, least: float, within: str = "24 hours", time: str = "ts") -> DataFrame:
    """The first row of each key that reaches `least` within a span of its first row. A key waits in the state until then; once the
    watermark has passed its span it is forgotten."""
    span = pd.Timedelta(within)

    def step(_, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        since, done = state.get if state.exists else (int(rows[time].iloc[0].value), False)
        end = pd.Timestamp(since) + span
        ready = rows[(rows[value] >= least) & (rows[time] <= end)]
        if not done and len(ready):
            yield ready.head(1)
        state.update((since, bool(done or len(ready))))
        state.setTimeoutTimestamp(max(end.value // 1_000_000, state.getCurrentWatermarkMs() + 1))

    return df.withWatermark(time, within).groupBy(key).applyInPandasWithState(step, df.schema, "since long, done boolean", "append", "EventTimeTimeout")


def changes(df: DataFrame, key: str, fields: tuple[str, ...], state_path: str, out_path: str, checkpoint: str):
    """Added and modified rows of each micro-batch against a state table that other jobs read too (keyed_changes has no such table),
    appended to out_path. A batch that runs again finds
    its number in the state and writes the same rows to the same place."""
    from ..operators.core import diff, union_first

    def batch(rows: DataFrame, n: int) -> None:
        state = State(rows.sparkSession, state_path)
        fresh = rows.groupBy(key).agg(F.max(F.struct(*fields)).alias("r")).select(key, "r.*")
        old = state.load()
        old = fresh.limit(0) if old is None else old
        diff(old, fresh, key, fields, only=("added", "modified")).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        state.save(union_first(key, fresh, old), keep=3)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what there is and give the rows as a table: for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def into_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run what there is into parquet files, exactly once. Batches without rows, which timers of the processing clock would call for without
    end, are not run: such timers wait for the next run."""
    spark, empty = df.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    timers = "ProcessingTime" in df._jdf.queryExecution().analyzed().toString()
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false" if timers else before)
    try:
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)
    q.awaitTermination()
    return spark.read.parquet(path)


def heard_once(df: DataFrame, state_path: str, out_path: str, checkpoint: str, seconds: float = 120, reach_km: float = 400, days: float = 9, priority: str = "priority"):
    """Reports (agency, id, t in seconds, lat, lon and a priority) of a stream with `cluster` ("agency:id" of the report that opened it) and `opens`,
    each (agency, id) once, appended to out_path. What was heard in the last `days` before the newest report is kept in a state table.

    A report near an opener of an earlier batch joins the first such; the others are merged among themselves as joins.clusters does. So what
    was told is never merged later. Near ones meet by slices of time, in as many tasks as there are slices. A batch that runs again
    leaves out of the state what it had written itself. Reports without agency, id, time or place take no part."""
    from ..operators.joins import clusters, km

    cols = ["agency", "id", "t", "lat", "lon", priority]

    def batch(rows: DataFrame, n: int) -> None:
        state = State(rows.sparkSession, state_path)
        old = state.load()
        old = rows.select(*cols).withColumns({"cluster": F.lit(""), "opens": F.lit(True), "batch": F.lit(0).cast("long")}).limit(0) if old is None else old.filter(F.col("batch") < n)
        whole = rows.select(*cols).dropna(subset=["agency", "id", "t", "lat", "lon"])
        once = whole.groupBy("agency", "id").agg(F.min(F.struct(priority, "t", "lat", "lon")).alias("r")).select("agency", "id", "r.*")
        fresh = once.join(old.select("agency", "id"), ["agency", "id"], "left_anti").withColumn("key", F.concat_ws(":", "agency", "id"))
        slot = F.floor(F.col("t") / seconds)
        heads = old.filter("opens").select(F.col("cluster").alias("head"), F.struct("batch", F.col(priority).alias("p"), "t", "cluster").alias("turn"), F.col("t").alias("ht"), F.col("lat").alias("hlat"), F.col("lon").alias("hlon"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
        near = fresh.withColumn("slot", slot).join(heads, "slot").filter((F.abs(F.col("t") - F.col("ht")) <= seconds) & (km(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon")) <= reach_km))
        joined = near.groupBy("key").agg(F.min_by("head", "turn").alias("cluster"))
        told = fresh.join(joined, "key", "left")
        rest = told.filter("cluster is null").select(F.col("key").alias("id"), "t", "lat", "lon", priority)
        own = clusters(rest, seconds, reach_km, priority).select(F.col("id").alias("key"), F.col("cluster").alias("own"))
        told = told.join(own, "key", "left").withColumns({"opens": F.col("cluster").isNull() & (F.col("own") == F.col("key")), "cluster": F.coalesce("cluster", "own")})
        told.select(*cols, "cluster", "opens").write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        told = rows.sparkSession.read.parquet(f"{out_path}/batch={n}").withColumn("batch", F.lit(n).cast("long"))
        kept = old.unionByName(told)
        newest = kept.agg(F.max("t").alias("newest"))
        state.save(kept.join(F.broadcast(newest)).filter(F.col("t") >= F.col("newest") - days * 86400).drop("newest"), keep=3)  # one row

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
