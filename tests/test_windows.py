"""Windows that close by silence, and rises with kept history: the state machine under a clock of our own, and whole streams."""

import collections
import random
import time

import pandas as pd
import pytest

from eventloom.streaming import ops, windows

S = 1_000_000


class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Store(dict):
    """A map or value state in memory."""

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self.get_(k)

    def get_(self, k):
        return dict.get(self, k)

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Value:
    v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Store()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Run:
    """One group under a manual clock; timers fire as the engine fires them, after a batch."""

    def __init__(self, processor):
        self.p, self.h, self.clock, self.out = processor, Handle(), Clock(), []
        self.p.init(self.h)

    def rows(self, events, size):
        w = lambda t: int(t * S // size * size)
        own = [(w(t), None, v, 1) for t, v in events if v]
        beats = {(w(t), int((t * S - w(t)) // (size // 10))) for t, _ in events}
        df = pd.DataFrame(own + [(a, b, None, 0) for a, b in sorted(beats)], columns=["w", "part", "value", "n"])
        for x in self.p.handleInputRows((0,), iter([df]), self.clock):
            self.out += list(x.itertuples(index=False, name=None))

    def wait(self, ms):
        self.clock.now += ms
        for t in sorted(x for x in self.h.timers if x <= self.clock.now):
            self.h.timers.remove(t)
            for x in self.p.handleExpiredTimer((0,), self.clock, None):
                self.out += list(x.itertuples(index=False, name=None))

    def take(self):
        out, self.out = self.out, []
        return sorted(out)


def test_last_window_is_told_after_silence():
    run = Run(windows.Windows(60 * S, 0, 5000))
    run.rows([(1, "a"), (30, "a"), (59, "b")], 60 * S)
    run.wait(4999)
    assert run.take() == []
    run.rows([(61, "a"), (70, None)], 60 * S)  # the first window has ended by event time; the timer starts anew
    assert run.take() == [(0, "a", 2, True), (0, "b", 1, True)]
    run.wait(4999)
    assert run.take() == []
    run.wait(1)
    assert run.take() == [(60 * S, "a", 1, False)]  # told, but the data end before its last tenth
    run.rows([(65, "late"), (110, "late"), (125, "c")], 60 * S)
    run.wait(5000)
    assert run.take() == [(120 * S, "c", 1, False)] and not run.h.timers


def test_first_window_is_whole_only_if_the_data_begin_with_it():
    for first, whole in ((3, True), (5.9, True), (7, False)):
        run = Run(windows.Windows(60 * S, 10 * S, 5000))
        run.rows([(first, "a"), (55, "a")], 60 * S)
        run.rows([(66, "b")], 60 * S)
        assert run.take() == []  # ten seconds late are allowed
        run.rows([(58, "a"), (72, "b")], 60 * S)
        assert run.take() == [(0, "a", 3, whole)]


def test_rises_early_and_at_the_end():
    run = Run(windows.Rises(60 * S, 0, 5000, 2, 3, 100.0, True))
    minute = lambda m, n, v="a": [(60 * m + i * 59 / max(n - 1, 1), v) for i in range(n)]
    run.rows(minute(0, 2) + minute(0, 9, "b"), 60 * S)
    run.rows(minute(1, 4) + minute(1, 9, "b"), 60 * S)
    assert run.take() == []  # the first window only counts; the second is open and 4 is not yet 100 % over 2 when it was told... it is
    run.rows(minute(2, 2), 60 * S)
    assert run.take() == [(60 * S, "a", 4, 2.0, 100.0, False)]
    run.rows(minute(2, 5), 60 * S)  # seven now, against (2 + 4) / 2
    assert run.take() == [(120 * S, "a", 7, 3.0, pytest.approx(400 / 3), True)]
    run.rows(minute(2, 5), 60 * S)
    assert run.take() == []  # told once
    run.wait(5000)
    assert run.take() == [(120 * S, "a", 12, 3.0, 300.0, False)]
    assert sorted(w for (w,) in run.p.past) == [0, 60 * S, 120 * S]
    run.rows(minute(3, 1), 60 * S)
    run.rows(minute(4, 1), 60 * S)
    run.wait(5000)
    assert len(run.p.past) == 3 and run.take() == []


def batch_trend(events, size, history, least, change):
    """Plain loops over whole, closed windows."""
    newest, first = max(t for t, _ in events), min(t for t, _ in events)
    by = collections.defaultdict(collections.Counter)
    for t, v in events:
        by[t // size * size][v] += 1
    slot = lambda t: t // (size // 10) * (size // 10)
    done = [w for w in sorted(by) if w + size <= slot(newest) and slot(first) < w + size // 10]
    out = []
    for i, w in enumerate(done):
        before = done[max(0, i - history) : i]
        for v, n in by[w].items():
            if before and n >= least:
                base = sum(by[x][v] for x in before) / len(before)
                rise = (n - base) / max(base, 1) * 100
                if rise >= change:
                    out.append((w, v, n, round(base, 2)))
    return sorted(out)


def test_trend_over_runs_of_a_stream(spark, tmp_path):
    """Five runs with one checkpoint, each with the next part of the events, equal one pass over all."""
    r = random.Random(3)
    events = sorted((int(r.random() * 3600 * 20), r.choice("abcdefgh") if r.random() < 0.8 else "burst" + str(r.randint(0, 2))) for _ in range(1500))
    schema = "t long, v string"
    got = []
    for part in range(5):
        rows = events[part * 300 : part * 300 + 300]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("timestamp_seconds(t) as ts", "v")
        got = ops.into_table(windows.trend(s, "v", 3600, history=3, min_count=4, min_change=50.0, groups=4), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = batch_trend(events, 3600, 3, 4, 50.0)
    name = lambda w: pd.Timestamp(w, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")
    assert sorted((x.window_start, x.value, x["count"], x.baseline) for x in got.collect()) == sorted((name(w), v, n, b) for w, v, n, b in want) and len(want) > 10


def test_a_stream_that_falls_silent(spark, tmp_path):
    schema = "t long, v string"
    spark.createDataFrame([(0, "a"), (30, "a"), (59, "b"), (61, "a"), (None, "x"), (62, None), (63, "")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("timestamp_seconds(t) as ts", "v")
    q = windows.counts(s, "v", 60, idle=3, groups=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        want = {("1970-01-01T00:00:00Z", "a", 2, True), ("1970-01-01T00:00:00Z", "b", 1, True), ("1970-01-01T00:01:00Z", "a", 1, False)}
        end, got = time.time() + 60, set()
        while time.time() < end and got != want:
            time.sleep(1)
            got = {tuple(x) for x in spark.read.schema("window_start string, value string, count long, complete boolean").parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
        assert got == want
    finally:
        q.stop()
