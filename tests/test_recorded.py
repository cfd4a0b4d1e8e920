"""Recorded frames and blocks: stops, failures and appends lose and repeat nothing."""

import json

import pytest

from eventloom.sources import posts, recorded
from eventloom.streaming import ops


def rows(spark, lo, hi, step=1):
    return spark.range(lo, hi, step).selectExpr("id as position", "concat('p', id) as payload")


def run(df, out, checkpoint):
    """One availableNow run: how many rows it read."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def test_frames_after_stops(spark, tmp_path):
    rec, out, cp = f"file://{tmp_path}/rec", f"{tmp_path}/out", f"{tmp_path}/cp"
    recorded.record(rows(spark, 0, 500), rec, "position")
    assert run(recorded.frames(spark, rec), out, cp) == 500
    recorded.record(rows(spark, 500, 800), rec, "position")
    assert run(recorded.frames(spark, rec), out, cp) == 300 and run(recorded.frames(spark, rec), out, cp) == 0
    recorded.record(rows(spark, 800, 801).union(rows(spark, 800, 801)), rec, "position")  # two frames of one cursor
    assert run(recorded.frames(spark, rec), out, cp) == 2
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, recorded.frames(spark, rec, stream=False).collect())) and len(got) == 802
    assert recorded.frames(spark, rec, stream=False, start="700").count() == 101
    assert recorded.frames(spark, f"{tmp_path}/none", stream=False).count() == 0


def test_a_batch_that_fails_is_read_again(spark, tmp_path):
    rec, cp = f"{tmp_path}/rec", f"{tmp_path}/cp"
    recorded.record(rows(spark, 0, 300), rec, "position")
    seen = []

    def batch(fail):
        def take(df, n):
            got = [r.position for r in df.collect()]
            if fail:
                raise RuntimeError("lost")
            seen.append((n, sorted(got)))

        return take

    start = lambda fail: recorded.frames(spark, rec).writeStream.foreachBatch(batch(fail)).option("checkpointLocation", cp).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start(True).awaitTermination()
    recorded.record(rows(spark, 300, 400), rec, "position")
    start(False).awaitTermination()  # the failed batch as it was planned
    start(False).awaitTermination()
    assert [n for n, _ in seen] == [0, 1] and seen[0][1] == list(range(300)) and seen[1][1] == list(range(300, 400))


def test_blocks_in_bounded_batches(spark, tmp_path):
    rec, out, cp = f"{tmp_path}/rec", f"{tmp_path}/out", f"{tmp_path}/cp"
    recorded.record(rows(spark, 100, 1000), rec, "position")
    source = lambda **k: recorded.blocks(spark, rec, lag=10, range=64, bound=250, progress=f"{tmp_path}/progress/q", **k)
    read = []
    while n := run(source(), out, cp):
        read.append(n)
        if len(read) == 2:  # blocks that come while the query stands
            recorded.record(rows(spark, 1000, 1100), rec, "position")
    assert read == [250, 250, 250, 240] and max(r.position for r in spark.read.parquet(out).collect()) == 1089
    recorded.record(rows(spark, 1100, 1111), rec, "position")  # the ten that were too new are sure now
    assert run(source(), out, cp) == 11
    got = sorted(r.position for r in spark.read.parquet(out).collect())
    assert got == list(range(100, 1101)) == sorted(r.position for r in recorded.blocks(spark, rec, stream=False, lag=10, range=64).collect())
    with pytest.raises(Exception, match="progress"):
        recorded.blocks(spark, rec, bound=5).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp2").start().awaitTermination()


def test_blocks_by_range_and_far_behind(spark, tmp_path):
    rec = f"{tmp_path}/rec"
    recorded.record(rows(spark, 0, 1000), rec, "position")
    o = recorded._Options({"path": rec, "lag": "0", "range": "300"})
    pieces = o.pieces(recorded.Recording(rec).refresh(), -1, 999)
    assert [(p.lo, p.hi) for p in pieces] == [(-1, 299), (299, 599), (599, 899), (899, 999)]
    assert run(recorded.blocks(spark, rec, lag=0, behind=120), f"{tmp_path}/o1", f"{tmp_path}/c1") == 120
    assert run(recorded.blocks(spark, rec, lag=100, start="recent", recent=50), f"{tmp_path}/o2", f"{tmp_path}/c2") == 50
    empty = recorded.blocks(spark, f"{tmp_path}/none")
    assert run(empty, f"{tmp_path}/o3", f"{tmp_path}/c3") == 0


def test_posts_of_recorded_frames(spark, tmp_path):
    frame = lambda i, lang: json.dumps({"did": f"d{i % 3}", "time_us": i, "kind": "commit", "commit": {"operation": "create", "collection": "app.bsky.feed.post", "rkey": str(i), "record": {"text": f"Text {i}", "langs": [lang]}}})
    df = spark.createDataFrame([(i, frame(i, "en-US" if i % 2 else "de")) for i in range(40)] + [(40, "{bad"), (41, None)], "position long, payload string")
    recorded.record(df, f"{tmp_path}/rec", "position")
    shaped = lambda stream: posts.jetstream(recorded.frames(spark, f"{tmp_path}/rec", stream=stream), langs=["en"])
    got = ops.into_table(shaped(True).select("key", "text"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(got.collect()) == sorted(shaped(False).select("key", "text").collect()) and got.count() == 20


def test_a_row_group_is_read_in_batches(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 3 * recorded.BATCH + 5
    pq.write_table(pa.table({"position": pa.array(range(n), pa.int64()), "payload": ["x"] * n}), f"{tmp_path}/a.parquet")
    piece = recorded.Piece(9, n - 3, [(f"{tmp_path}/a.parquet", 0)])
    got = list(recorded.Recording(str(tmp_path)).read(piece))
    assert max(map(len, got)) <= recorded.BATCH and [x for b in got for x in b.column(0).to_pylist()] == list(range(10, n - 2))
