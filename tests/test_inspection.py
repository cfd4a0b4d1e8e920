"""Inspection of bodies of each kind."""

from eventloom.sources.inspection import inspect


def test_kinds_and_checks(spark):
    product = '<html><title> A  b </title><script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"],"name":"x","offers":{"price":1}},{"@type":"WebSite"}]}</script><body>' + "word " * 90
    app = '<body><div id="app"> </div><script></script></body>'
    scripts = "<body><p>few words</p><script>1</script><script>2</script><script>3</script></body>"
    filled = '<body><div id="root">few words</div><script></script></body>'
    feed = '<head><link rel="alternate" type="application/rss+xml" href="/f.xml"><meta property="og:title" content="T"><meta property="product:price:amount" content="5"></head>' + "word " * 100
    rows = [("http://e.org/1", product), ("http://e.org/2", app), ("http://e.org/3", scripts), ("http://e.org/4", filled), ("http://e.org/5", feed), ("http://e.org/6", ' {"a": 1}'), ("http://e.org/7", "<?xml version='1.0'?><rss></rss>"), ("http://e.org/8", None), ("http://e.org/9", "{no json")]
    got = {r.url[-1]: r for r in inspect(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert {k: r.kind for k, r in got.items()} == {**{str(i): "page" for i in range(1, 10)}, "6": "json", "7": "feed"}
    assert (got["1"].title, got["1"].types, got["1"].products, got["1"].method, got["1"].needs_scripts) == ("A b", ["Product", "Thing", "WebSite"], 1, "json-ld", False)
    assert [got[k].needs_scripts for k in "2348"] == [True, True, False, False] and got["2"].suggestions == ["render it first"]
    assert got["5"].method == "opengraph" and got["5"].feeds == ["http://e.org/f.xml"] and got["5"].suggestions == ["html.pages: products, then diff", "feeds.entries of http://e.org/f.xml"]
    assert got["6"].suggestions == ["files.read"] and got["7"].suggestions == ["feeds.entries"] and [c.name for c in got["7"].checks] == ["feed"]
    assert [(c.name, c.ok) for c in got["2"].checks] == [("JSON-LD", False), ("Products", False), ("Feeds", False), ("Readable", False)] and got["4"].suggestions == ["html.pages", "selectors.records"]


def test_title_with_a_reference_cut_off(spark, tmp_path):
    from eventloom import queries

    html = "<html><head><title> One &amp; \n two&amp</title></head><body>" + "word " * 90
    spark.createDataFrame([(1, "http://e.org/1", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = inspect(spark.read.parquet(f"{tmp_path}/pages.parquet")).first()
    assert (row.title, row.written) == ("One & two&", "One &amp; two&amp")
    assert queries.html_inspection(spark, str(tmp_path)).first().title == "One & two&amp"
