from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import durations
from eventloom.functions import text as X
from eventloom.operators import catalog, core, joins, search, series
from eventloom.sources import html, records

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, v, who, T0 + timedelta(minutes=m)) for i, (m, v, who) in enumerate(rows)], "event_id long, t string, who string, ts timestamp")


def test_select_takes_the_first_value_that_is_there(spark):
    df = spark.createDataFrame([(None, "b", 1), ("a", "b", 2)], "x string, y string, n int")
    assert [tuple(r) for r in core.select(df, "v=x|y", "n", "none=zz").collect()] == [("b", 1, None), ("a", 2, None)]
    with pytest.raises(ValueError):
        core.select(df, "x", "x=y")


def test_map_is_sequential_and_makes_structs(spark):
    r = core.assign(spark.createDataFrame([(2,)], "n int"), "m=n * 2", "o.p=m + 1", drop=("n",)).first()
    assert (r.m, r.o.p) == (4, 5) and "n" not in r


def test_grep_words_not_in_links(spark):
    df = spark.createDataFrame([(1, "An Apple a day"), (2, "see https://apple.com/x"), (3, "pineapple")], "id int, text string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(core.grep(df, "apple")) == [1]
    assert ids(core.grep(df, "apple", substring=True)) == [1, 3]
    assert ids(core.grep(df, "apple.com")) == [2]
    assert ids(core.grep(df, "apple", invert=True)) == [2, 3]
    assert ids(core.grep(df, "Apple", case_sensitive=True, field=("text",))) == [1]


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "a", None), (1, "a", None), (3, "b", None), (4, None, "x")], "n int, key string, z string")
    assert sorted(r.n for r in core.dedupe(df, order="n").collect()) == [1, 3, 4]


def test_sort_numbers_text_missing(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "10"), (4, "9"), (5, "A"), (6, "1e1")], "n int, k string")
    assert [r.n for r in core.sort(df, "k", order="n").collect()] == [4, 3, 6, 5, 1, 2]
    assert [r.n for r in core.sort(df, "k", reverse=True, order="n").collect()] == [1, 5, 3, 6, 4, 2]


def test_extract(spark):
    df = spark.createDataFrame([("Buy $tsla and #Big #big @bob http://www.a.com/x the lamp's",)], "text string")
    get = lambda w, **k: core.extract(df, w, ("text",), "x", **k).first().x
    assert get("hashtags") == ["#big"] and get("cashtags") == ["$TSLA"] and get("domains") == ["a.com"]
    assert "lamp's" in get("words") and "the" not in get("words") and "bob" not in get("words")


def test_windows(spark):
    df = events(spark, [(5, "x", "a"), (50, "x", "a"), (65, "x", "b"), (20, "y", "a"), (70, "z", "b")])
    got = {(r.window_start[11:13], r.value, r["count"]) for r in core.count(df, "t", 3600).collect()}
    assert got == {("00", "x", 2), ("00", "y", 1), ("01", "x", 1), ("01", "z", 1)}


def test_completeness(spark):
    df = events(spark, [(m, "x", "a") for m in range(30, 126, 5)])
    got = {r.window_start[11:13]: r.complete for r in core.count(df, "t", 3600).collect()}
    assert got == {"00": False, "01": True, "02": False}


def test_distinct_count_and_order_do_not_matter(spark):
    rows = [(i % 50, "loud", "one") for i in range(50)] + [(i, "wide", w) for i, w in enumerate("abc")]
    got = {r.value: r["count"] for r in core.count(events(spark, rows), "t", 3600, distinct="who").collect()}
    assert got == {"loud": 1, "wide": 3}


def test_spikes(spark):
    rows = [(h * 60 + m, v, "a") for h in range(3) for m, v in ((1, "x"), (58, "x"), (2, "y"), (3, "y"))]
    rows = [(m, v, w) for m, v, w in rows if not (v == "x" and m % 60 == 58)] + [(h * 60 + 59, "fill", "a") for h in range(4)]
    rows += [(181 + i, "x", "a") for i in range(9)] + [(200 + i, "new", "a") for i in range(4)]
    got = {r.value: (r["count"], r.baseline, r.title) for r in core.trend(core.count(events(spark, rows), "t", 3600)).collect()}
    assert got == {"x": (9, 1.0, "x +800%"), "new": (4, 0.0, "new new")}


def test_truncated_windows_have_a_floor(spark):
    c = spark.createDataFrame([("w0", "a", 5, True, True), ("w1", "b", 12, True, True)], "window_start string, value string, count long, truncated boolean, complete boolean")
    assert [r.baseline for r in core.trend(c).collect()] == [5.0]


def test_diff(spark):
    s = "k string, price int, url string"
    old = spark.createDataFrame([("a", 1, "u"), ("b", 2, "u"), ("c", 3, "v")], s)
    new = spark.createDataFrame([("a", 1, "u"), ("b", 5, "u"), ("d", 4, "u")], s)
    got = {(r.k, r.change): r.fields for r in core.diff(old, new, "k", ("price",), fetched="url").collect()}
    assert set(got) == {("b", "modified"), ("d", "added")}
    assert tuple(got["b", "modified"][0]) == ("price", "2", "5")
    assert {r.k for r in core.diff(old, new, "k", ("price",), only=("removed",)).collect()} == {"c"}


def test_as_of(spark):
    p = spark.createDataFrame([("a", T0 + timedelta(days=d), float(d)) for d in range(0, 10, 3)], "k string, t timestamp, v double")
    q = spark.createDataFrame([(i, "a", T0 + timedelta(days=d)) for i, d in enumerate((0, 1.5, 4, 30, -1))] + [(9, "z", T0)], "i int, k string, t timestamp")
    back = {r.i: r.value for r in joins.as_of(q, p, ["k"], "t", "t", "v", 172800).collect()}
    ahead = {r.i: r.value for r in joins.as_of(q, p, ["k"], "t", "t", "v", 172800, forward=True).collect()}
    assert back == {0: 0.0, 1: 0.0, 2: 3.0, 3: None, 4: None, 9: None}
    assert ahead == {0: 0.0, 1: 3.0, 2: 6.0, 3: None, 4: 0.0, 9: None}


def test_quakes_join_their_first_cluster(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 10.0, 1), (2, 60.0, 10.5, 10.0, 2), (3, 100.0, 50.0, 10.0, 1), (4, 1000.0, 10.0, 10.0, 1)], "id long, t double, lat double, lon double, priority int")
    assert {r.id: r.cluster for r in joins.clusters(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_mirrored_legs_go(spark):
    df = spark.createDataFrame([("t", "x", 5.0, "a", "b"), ("t", "x", 5.0, "b", "a"), ("t", "x", 6.0, "a", "b")], "tx string, address string, value double, from string, to string")
    assert [r.value for r in records.transfers(df, 1.0).collect()] == [6.0]


def test_streaks_and_carried(spark):
    df = spark.createDataFrame([("s", d, v) for d, v in enumerate((1, 0, 0, None, 0, 1))], "s string, d int, v int")
    assert sorted(tuple(r)[1:] for r in series.streaks(df, ["s"], "d", F.col("v") == 0).collect()) == [(1, 2, 2), (4, 4, 1)]
    assert [r.c for r in series.carried(df, ["s"], "d", "v", "c").orderBy("d").collect()] == [1, 0, 0, 0, 0, 1]


def test_trades(spark):
    rows = [("f", "P", 10.0, 2.0, 10.0, "2024-01-02", 1), ("f", "P", 30.0, 4.0, 40.0, "2024-01-01", 2), ("f", "P", 5.0, None, 45.0, "2024-01-03", 3), ("g", "S", 1e6, 20000.0, 0.0, "2024-01-01", 1)]
    df = spark.createDataFrame(rows, "filing string, code string, shares double, price double, after double, day string, seq int")
    got = {r.filing: r for r in records.trades(df, "filing", "code", "shares", "price", "after", "day", "seq").collect()}
    assert (got["f"].shares, got["f"].price, got["f"].value, got["f"].shares_after, got["f"].traded_on) == (45.0, 3.5, 140.0, 45.0, "2024-01-01")
    assert (got["g"].price, got["g"].filed_price) == (None, 20000.0)


def test_stems_and_keys(spark):
    ws = ["hacks", "hacked", "companies", "company", "crashes", "class", "news", "wing", "cities", "uses"]
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    assert [r[0] for r in df.select(X.stem(df.w)).collect()] == ["hack", "hack", "compan", "compan", "crash", "class", "news", "wing", "citie", "use"]


def test_item_keys_ignore_case_and_spaces(spark):
    df = spark.createDataFrame([("f", "l", "A  Title"), ("f", "l", "a title "), ("f", "m", "a title")], "feed string, link string, title string")
    k = [r[0] for r in df.select(X.item_key(df.feed, df.link, df.title)).collect()]
    assert k[0] == k[1] != k[2] and len(k[0]) == 16


def test_sizes(spark):
    ts = ["Ronin Bridge: $624M lost", "M 7.5 - Noto", "Leak (1,204,337 affected)", "Hedera +20.4% in a day", "Typhoon peaked at 125-knot winds", "S&P 500: 7,743.41", "Report for 10 September", "VEI: 2011 6"]
    df = spark.createDataFrame([(x,) for x in ts], "t string")
    assert [r[0] for r in df.select(X.size(df.t)).collect()] == [624e6, 7.5, 1204337.0, 20.4, 125.0, 7743.41, None, 6.0]


def test_incremental_index_is_the_rebuilt_one(spark):
    s = "feed string, title string, summary string, link string, date string, n int"
    a = catalog.with_keys(spark.createDataFrame([("f", "Big hacks", None, "1", "2024-01-05", 1), ("f", "Lamps", None, "2", "2024-02-05", 2)], s))
    b = catalog.with_keys(spark.createDataFrame([("f", "big  hacks", None, "1", "2024-01-06", 3), ("g", "Hacked lamps", None, "3", "", 4)], s), now="2024-03")
    both = catalog.upsert(catalog.upsert(a.limit(0), a, ["n"]), b, ["n"])
    assert sorted(r.n for r in both.collect()) == [1, 2, 4]
    rebuilt = {(r.word, r.feed): r.months for r in catalog.postings(both).collect()}
    assert rebuilt["hack", "f"] == ["2024-01"] and rebuilt["hack", "g"] == ["2024-03"]


def test_search_and_repair(spark):
    items = spark.createDataFrame([("k1", "news", "Bitcoin hacked again", "bridge", "2024-01-01"), ("k2", "news", "Quiet day", "a bitcoin hack", "2024-01-02"), ("k3", "x", "Nothing", "", "2024-01-03")], "key string, feed string, title string, summary string, date string")
    assert [r.key for r in search.find(items, ["bitcoin", "hacks"], limit=5).collect()] == ["k2", "k1"]
    assert [r.key for r in search.rank(items, ["bitcoin", "hacks"]).orderBy("rank").collect()] == ["k1", "k2"]
    fixed = search.repair(spark.createDataFrame([("bitcion",), ("zzzzzzz",)], "word string"), search.vocabulary(items))
    assert [tuple(r) for r in fixed.collect()] == [("bitcion", "bitcoin")]
    assert search.edits("bitcion", "bitcoin", 1) == 1 and search.edits("abcd", "badc", 1) == 2


def test_pages(spark):
    page = """<html lang=en><head><title> A  page </title><link rel=canonical href=/c><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Lamp","offers":[{"price":"9","sku":"s","availability":"https://schema.org/InStock"}]}]}</script></head>
<body><h1>Head <b>line</b></h1><p>Seen<span style="display:none">not</span></p><a href="x?a=1">go &amp; see</a><table><tr><th>a</th></tr><tr><td>1</td></tr></table><script>no()</script></body></html>"""
    r = html.pages(spark.createDataFrame([("http://e.org/p/", page), ("u", None)], "url string, html string")).filter("url <> 'u'").first()
    assert (r.title, r.canonical, r.lang, r.text) == ("A page", "http://e.org/c", "en", "Head line\nSeen\ngo & see\na\n1")
    assert (tuple(r.links[0]), tuple(r.headings[0]), r.records) == (("http://e.org/p/x?a=1", "go & see"), (1, "Head line"), [{"a": "1"}])
    assert tuple(r.products[0]) == ("Lamp", "s", "9", None, "InStock")


def test_durations():
    assert durations.parse("1h30m") == 5400 and durations.show(5400) == "90m" and durations.parse("1.5h") == 5400 and durations.parse("0.5 s") == 0.5 and durations.show(86400) == "1d" and durations.show(61) == "61s" and durations.show(7200) == "2h" and durations.parse("2d") == 172800
    with pytest.raises(ValueError):
        durations.parse("soon")


def test_clusters_compare_only_reports_of_cells_beside(monkeypatch):
    """Reports all over the world at once: the same clusters as by comparing each with all openers, with few distances computed."""
    import random

    import pandas as pd

    r, calls = random.Random(5), [0]
    rows = [(i, r.random() * 500, r.uniform(-90, 90), r.uniform(-180, 180), i % 3) for i in range(3000)]
    rows += [(3000 + i, r.random() * 500, r.choice([-89.9, 0.0, 89.9]), r.choice([-179.9, 179.9]), 1) for i in range(200)]
    want, heads = {}, []
    for i, t, lat, lon, _ in sorted(rows, key=lambda x: (x[4], x[1], x[0])):
        want[i] = next((h[0] for h in heads if abs(h[1] - t) <= 120 and joins._km(h[2], h[3], lat, lon) <= 400), i)
        heads += [(i, t, lat, lon)] if want[i] == i else []
    plain = joins._km
    monkeypatch.setattr(joins, "_km", lambda *x: (calls.__setitem__(0, calls[0] + 1), plain(*x))[1])
    group = pd.DataFrame(rows, columns=["id", "t", "lat", "lon", "p"]).assign(b=0, g=0, opens=True, cluster=lambda x: x["id"])
    got = joins._settle(group, 120, 400)
    assert dict(zip(got["id"], got["cluster"], strict=True)) == want and calls[0] < len(rows) * 60
