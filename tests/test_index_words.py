"""The words of the stored index: once each, in their shards, however often a task sends its lists on."""

import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.operators import catalog, index


def test_words_against_stems(spark, tmp_path):
    texts = ["Themes theme cars car's the th 12 123abc", "éclair Éclairs naïve ab", None, "", "the Filing filings filed"]
    rows = [(i, ["a", "b", None][i % 3], texts[i % 5], f"word{i % 4} theme", f"2021-0{i % 2 + 1}", f"2021-0{i % 2 + 1}-03") for i in range(60)]
    items = spark.createDataFrame(rows, "id long, feed string, title string, summary string, month string, date string")
    index.write(items, str(tmp_path))
    got = sorted(map(repr, spark.read.parquet(f"{tmp_path}/words").select("word", "month", "feed").collect()))
    want = catalog.stems(items, F.concat_ws("\n", "title", "summary")).select("word", "month", "feed").collect()
    assert got == sorted(map(repr, want))
    assert all(index.shard_of(r.word) == r.shard for r in spark.read.parquet(f"{tmp_path}/words").collect())


def test_lists_sent_on_often_hold_the_same_words(monkeypatch):
    b = pa.record_batch([["m", "m", "n"] * 9, ["a", None, "a"] * 9, [[f"word{i % 7}", f"abc{i % 5}", "éclair"] for i in range(27)]], ["month", "feed", "words"])
    flat = lambda out: [(s, p, m, f, w) for x in out for s, p, m, f, ws in zip(*x.to_pydict().values(), strict=True) for w in ws]
    once = flat(index._lists(iter([b, b])))
    assert len(once) == len(set(once)) and {(m, f, w) for _, _, m, f, w in once} == {(m, f, w) for m, f, ws in zip(*b.to_pydict().values(), strict=True) for w in ws}
    monkeypatch.setattr(index, "HELD", 10)
    often = flat(index._lists(iter([b, b])))
    assert len(often) > len(once) and set(often) == set(once)


def test_words_are_shuffled_once_as_lists(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda self, *a, f=type(spark.range(1)).sortWithinPartitions, **k: (seen.append(self), f(self, *a, **k))[1])
    index.write(spark.createDataFrame([(1, "a", "one two", "x", "2021-01", "2021-01-03")], "id long, feed string, title string, summary string, month string, date string"), str(tmp_path))
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(seen[-1]._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1, plan
