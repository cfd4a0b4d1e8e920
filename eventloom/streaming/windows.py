"""Windows of a live stream that close by event time or by silence, their counts, and rises against the windows before them.

Values are dealt to groups by hash; a group's state has the counts of its open windows and, for rises, those of the last closed ones. Beside the rows
every group gets a beat for each tenth of a window in which anything happened: so all groups know the same windows, when the data begin and how
far they are, whatever values they have themselves, and a group whose values are rare does not take its own silence for that of the stream.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Groups of values; their number is part of a query's checkpoint.
GROUPS = 64
PARTS = 10
#: What a closed window says of each value, and what a rise says.
COUNTS = "window_start long, value string, count long, complete boolean"
RISES = "window_start long, value string, count long, baseline double, change double, early boolean"
NO_DATA = -(1 << 60)


def use_timers(spark: SparkSession) -> None:
    """Keyed state with timers is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Windows(StatefulProcessor):
    """Counts of one group. Rows: w (start of the window), value, n; beats: w, part (which tenth) and no value. All times are microseconds, timers are
    milliseconds of the processing clock."""

    def __init__(self, size: int, late: int, idle: int):
        self.size, self.late, self.idle = size, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "w long", "values array<string>, counts array<long>, said array<string>")
        self.meta = handle.getValueState("meta", "closed long, first long, newest long, timer long")

    def close(self) -> None:
        pass

    # What has been seen: up to where windows are closed, the first and the newest beat, and when silence ends the open ones.
    def _meta(self) -> list[int]:
        return list(self.meta.get()) if self.meta.exists() else [NO_DATA, NO_DATA, NO_DATA, 0]

    def _held(self, w: int) -> tuple[Counter, list[str]]:
        kept = self.open.getValue((w,))
        return (Counter(dict(zip(kept[0], kept[1], strict=True))), list(kept[2])) if kept else (Counter(), [])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        closed, first, newest, timer = self._meta()
        got = pd.concat(list(rows), ignore_index=True)
        got = got[got["w"] >= closed]  # what comes after its window was told is dropped
        beats = got[got["value"].isna()]
        slots = (beats["w"] + beats["part"] * (self.size // PARTS)).astype("int64")
        if len(slots):
            first = int(slots.min()) if first == NO_DATA else min(first, int(slots.min()))
            newest = max(newest, int(slots.max()))
        for w in sorted(set(beats["w"].astype("int64"))):
            if not self.open.containsKey((w,)):
                self.open.updateValue((w,), ([], [], []))
        for w, part in got[got["value"].notna()].groupby("w"):
            w = int(w)
            counts, said = self._held(w)
            counts.update(part.groupby("value")["n"].sum().astype(int).to_dict())
            early = self.early(w, counts, set(said))
            if early is not None and len(early):
                said += early["value"].tolist()
                yield early
            self.open.updateValue((w,), (list(counts), list(counts.values()), said))
        ready = sorted(w for (w,) in list(self.open.keys()) if w + self.size + self.late <= newest)
        for w in ready:
            yield from self._told(w, first, newest)
            closed = max(closed, w + self.size)
        if timer:
            self.handle.deleteTimer(timer)
        timer = now + self.idle
        self.handle.registerTimer(timer)
        self.meta.update((closed, first, newest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: what is open ends now."""
        closed, first, newest, _ = self._meta()
        for w in sorted(w for (w,) in list(self.open.keys())):
            yield from self._told(w, first, newest)
            closed = max(closed, w + self.size)
        self.meta.update((closed, first, newest, 0))

    def _told(self, w: int, first: int, newest: int) -> Iterator[pd.DataFrame]:
        counts, _ = self._held(w)
        self.open.removeKey((w,))
        whole = first < w + self.size // PARTS and newest >= w + self.size - self.size // PARTS
        out = self.report(w, counts, whole)
        if out is not None and len(out):
            yield out

    def early(self, w: int, counts: Counter, said: set[str]) -> pd.DataFrame | None:
        return None

    def report(self, w: int, counts: Counter, whole: bool) -> pd.DataFrame | None:
        return pd.DataFrame({"window_start": w, "value": list(counts), "count": list(counts.values()), "complete": whole})


class Rises(Windows):
    """Values that rise. The last `history` whole windows are kept in the state; of an open window a value is told early, once, when it has risen already."""

    def __init__(self, size: int, late: int, idle: int, history: int, min_count: int, min_change: float, tell_early: bool):
        super().__init__(size, late, idle)
        self.history, self.min_count, self.min_change, self.tell_early = history, min_count, min_change, tell_early

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getMapState("past", "w long", "values array<string>, counts array<long>")

    def _risen(self, w: int, counts: Counter, early: bool, without: set[str] = frozenset()) -> pd.DataFrame | None:
        before = sorted(x for (x,) in list(self.past.keys()) if x < w)[-self.history :]
        if not before:
            return None
        earlier = [dict(zip(*self.past.getValue((x,)), strict=True)) for x in before]
        out = []
        for value, n in counts.items():
            if n >= self.min_count and value not in without:
                baseline = sum(e.get(value, 0) for e in earlier) / len(earlier)
                change = (n - baseline) / max(baseline, 1.0) * 100
                if change >= self.min_change:
                    out.append((w, value, n, baseline, change, early))
        return pd.DataFrame(out, columns=["window_start", "value", "count", "baseline", "change", "early"])

    def early(self, w: int, counts: Counter, said: set[str]) -> pd.DataFrame | None:
        return self._risen(w, counts, True, said) if self.tell_early else None

    def report(self, w: int, counts: Counter, whole: bool) -> pd.DataFrame | None:
        if not whole:
            return None
        out = self._risen(w, counts, False)
        self.past.updateValue((w,), (list(counts), list(counts.values())))
        for x in sorted(x for (x,) in list(self.past.keys()))[: -self.history - 1]:
            self.past.removeKey((x,))
        return out


def _rows(df: DataFrame, by: str, size: int, late: int, time: str, groups: int) -> DataFrame:
    """g, w, part, value, n: rows by group of their value, and beats for every group. A row without value makes a beat too."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    w = F.floor(micros / size).cast("long") * size
    text = F.nullif(F.col(by).cast("string"), F.lit(""))
    dated = df.filter(F.col(time).isNotNull()).withWatermark(time, f"{late + size} microseconds")
    none = F.lit(None).cast("int")
    own = dated.filter(text.isNotNull()).select(F.pmod(F.xxhash64(text), F.lit(groups)).cast("int").alias("g"), w.alias("w"), none.alias("part"), text.alias("value"), F.lit(1).cast("long").alias("n"))
    slot = F.window(time, f"{size // PARTS} microseconds")
    beats = dated.select(slot.alias("s")).dropDuplicates(["s"])
    at = F.unix_micros(F.col("s.start").cast("timestamp"))
    start = F.floor(at / size).cast("long") * size
    beats = beats.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), start.alias("w"), F.floor((at - start) / (size // PARTS)).cast("int").alias("part"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    return own.unionByName(beats)


def _started(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.date_format(F.timestamp_micros("window_start"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def counts(df: DataFrame, by: str, every: float, idle: float | None = None, late: float = 0, time: str = "ts", groups: int = GROUPS) -> DataFrame:
    """window_start, value, count, complete of windows of `every` seconds. A window closes when the data are `late` seconds past its end, or
    when nothing at all came for `idle` seconds of real time (a tenth of the window, a minute at most); so the last window is told too.
    Rows of a closed window are dropped. A window that the data cover in part only (they begin after its first tenth, or end before its last) is not complete."""
    use_timers(df.sparkSession)
    size = int(every * 1_000_000)
    processor = Windows(size, int(late * 1_000_000), int(1000 * (min(every / 10, 60) if idle is None else idle)))
    out = _rows(df, by, size, int(late * 1_000_000), time, groups).groupBy("g").transformWithStateInPandas(processor, COUNTS, "Append", "ProcessingTime")
    return _started(out)


def trend(df: DataFrame, by: str, every: float, history: int = 6, min_count: int = 3, min_change: float = 100.0, early: bool = False, idle: float | None = None, late: float = 0, time: str = "ts", groups: int = GROUPS) -> DataFrame:
    """window_start, value, count, baseline, change_pct, early: values that rise against their mean over the last `history` whole windows,
    which the checkpoint keeps between runs. The first whole window only counts; windows covered in part are neither told nor kept.
    With `early`, a value of an open window is told as soon as it has risen, once; when the window closes it is told with its whole count."""
    use_timers(df.sparkSession)
    size = int(every * 1_000_000)
    processor = Rises(size, int(late * 1_000_000), int(1000 * (min(every / 10, 60) if idle is None else idle)), history, min_count, min_change, early)
    out = _rows(df, by, size, int(late * 1_000_000), time, groups).groupBy("g").transformWithStateInPandas(processor, RISES, "Append", "ProcessingTime")
    return _started(out).select("window_start", "value", "count", F.round("baseline", 2).alias("baseline"), F.round("change", 1).alias("change_pct"), "early")
