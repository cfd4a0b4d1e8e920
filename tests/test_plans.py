from datetime import date

import pytest

from eventloom.plans import pipeline as P
from eventloom.plans.state import State
from eventloom.sources import feeds, files, sinks
from eventloom.streaming import ops


def test_stages_are_checked_with_hints(spark):
    with pytest.raises(P.PipelineError, match="did you mean 'filter'"):
        P.check([{"fliter": {}}])
    with pytest.raises(P.PipelineError, match="did you mean 'patterns'"):
        P.check([{"grep": {"pattern": ["x"]}}])


def test_endless_sources_need_a_limit(spark, tmp_path):
    s = spark.readStream.schema("seq int, k string").json(str(tmp_path))
    with pytest.raises(P.PipelineError, match="no end"):
        P.build(s, [{"sort": {"by": ["k"]}}], P.Context(spark))


def test_pipeline_from_yaml(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"seq": 1, "title": "big lamp", "price": "9"}\n{"seq": 2, "title": "big sale", "price": "12"}\n{"seq": 3, "title": "small", "price": "20"}\n')
    spec = P.load(f"""
sources: [{{file: {{path: {tmp_path}/in.jsonl}}}}]
operators:
  - grep: {{patterns: [big]}}
  - map: {{set: ["double=price * 2"]}}
  - filter: {{expr: "double > 20"}}
  - select: {{fields: [title, double]}}
outputs: [{{csv: {{path: {tmp_path}/out}}}}]
""")
    assert [tuple(r) for r in P.run(spark, spec).collect()] == [("big sale", 24.0)]
    assert files.read(spark, f"{tmp_path}/out", "csv").count() == 1


def test_diff_between_runs(spark, tmp_path):
    ctx, s = P.Context(spark, state=str(tmp_path / "state")), "seq int, k string, v int"
    run = lambda rows: sorted((r.k, r.change) for r in P.build(spark.createDataFrame(rows, s), [{"diff": {"key": "k", "fields": ["v"]}}], ctx).collect())
    assert run([(1, "a", 1), (2, "b", 1)]) == []
    assert run([(1, "a", 1), (2, "b", 1)]) == []
    assert run([(1, "a", 2), (2, "c", 1)]) == [("a", "modified"), ("b", "removed"), ("c", "added")]


def test_state_is_written_only_if_changed(spark, tmp_path):
    s = State(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert s.save(df) and not s.save(df) and s.version() == 1
    assert s.save(df.union(df)) and s.load().count() == 2


def test_macros_and_backfill(spark):
    assert P.expand({"a": ["${TODAY} ${DAYS_AGO_2} ${YEAR}"]}, date(2024, 3, 1)) == {"a": ["2024-03-01 2024-02-28 2024"]}
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "a", "2024-01-09"), (3, "b", "2024-01-09"), (4, "c", "2025-01-01")], "seq int, key string, t string")
    got = P.backfill(df, date(2024, 1, 1), date(2024, 2, 1), 7, [{"filter": {"expr": "seq > 0"}}, {"limit": {"count": 1}}], P.Context(spark), "t", "key")
    assert sorted((r.key, str(r.window)) for r in got.collect()) == [("a", "2024-01-01"), ("b", "2024-01-08")]


def test_watch_goes_on_after_a_failure(spark, tmp_path):
    good = f"sources: [{{file: {{path: {tmp_path}/x.jsonl}}}}]"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    texts = iter(["sources: []\nbad: 1", good])
    assert len(P.watch(spark, lambda: next(texts), "1s", rounds=2, sleep=lambda s: None)) == 1


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", {"x": 1}, ("n", [1, 2]))], "id string, title string, m map<string,int>, s struct<n:string,l:array<int>>")
    sinks.csv(df, str(tmp_path / "c"))
    assert set(files.read(spark, str(tmp_path / "c"), "csv").columns) == {"id", "title", "m", "s.n", "s.l"}
    rows = df.select("id", "title")
    sinks.insert_or_ignore(rows, str(tmp_path / "t"))
    sinks.insert_or_ignore(rows.union(spark.createDataFrame([("2", "B")], "id string, title string")), str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["1", "2"]
    sinks.jsonl(rows, str(tmp_path / "j"))
    assert files.lines(spark, str(tmp_path / "j")).count() == 1


def test_feeds(spark):
    rss = "<rss><channel><item><guid>g1</guid><title>A &amp; B</title><link>http://e.org/?utm_source=x&amp;id=1</link><description><![CDATA[<p>Hi</p>]]></description><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item></channel></rss>"
    atom = '<feed><entry><id>e1</id><title>T</title><link href="http://e.org/2"/><summary>s</summary><updated>2024-03-05T10:00:00Z</updated></entry></feed>'
    js = '{"items": [{"id": "j1", "title": "J", "url": "http://e.org/3", "content_text": "c", "date_published": "2024-03-05T10:00:00Z"}]}'
    got = {r.key: r for r in feeds.entries(spark.createDataFrame([(rss,), (atom,), (js,)], "body string")).collect()}
    assert set(got) == {"g1", "e1", "j1"} and got["g1"].title == "A & B" and got["g1"].timestamp == got["e1"].timestamp == "2024-03-05T10:00:00Z"
    assert got["e1"].link == "http://e.org/2" and got["g1"].summary == "Hi"


def test_stream_counts_are_batch_counts_of_closed_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = spark.sql("select id, timestamp_seconds(id * 600) as ts, if(id % 3 = 0, 'x', 'y') as v from range(40)")
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r.window_start, r.value): r["count"] for r in ops.into_table(ops.counts(s, "v", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    want = {}
    for i in range(36):
        k = (f"1970-01-01T0{i // 6}:00:00Z", "x" if i % 3 == 0 else "y")
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_stream_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: ops.changes(spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in")), "k", ("v",), str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    go()
    spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted((r.batch, r.k, r.change) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(0, "a", "added"), (0, "b", "added"), (1, "a", "modified")]


def test_stream_changes_by_key(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k string, v int, w string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: ops.into_table(ops.keyed_changes(spark.readStream.schema("k string, v int, w string").parquet(str(tmp_path / "in")), "k", ("v", "w")), str(tmp_path / "o"), str(tmp_path / "c"))
    put([("a", 1, None), ("b", 1, "x")])
    assert sorted(tuple(r) for r in go().collect()) == [("a", "added", None), ("b", "added", None)]
    put([("a", 2, None), ("b", 1, "x"), ("c", None, None)])
    assert sorted((r.k, r.change, r.fields and [tuple(f) for f in r.fields]) for r in go().collect())[1:] == [("a", "modified", [("v", "1", "2")]), ("b", "added", None), ("c", "added", None)]


def test_errors_pass_by_diff(spark, tmp_path):
    from eventloom.plans import pipeline

    ctx = pipeline.Context(spark, order="seq", state=str(tmp_path / "state"))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, type string, seq int")
    go = lambda df: sorted((r.k, r.change, r.fields and [(f.path, f.old, f.new) for f in r.fields]) for r in pipeline._diff(df, ctx, "k", ["v"]).collect())
    assert go(rows(("a", 1, "item", 1), ("b", 1, None, 2), ("x", None, "error", 3))) == [("x", "error", None)]
    assert go(rows(("a", 2, "item", 1), ("b", None, "error", 2), ("b", 1, "item", 3))) == [("a", "modified", [("v", "1", "2")]), ("b", "error", None)]
