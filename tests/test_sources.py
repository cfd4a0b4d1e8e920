from datetime import date

from eventloom.operators import answers
from eventloom.sources import forms, html, posts, records


def test_shapes(spark):
    one = lambda kind, body: posts.shaped(spark.createDataFrame([(body,)], "payload string"), kind).first()
    r = one("release", '{"html_url": "u", "tag_name": "v1", "published_at": "2024-03-05T10:00:00Z", "body": "<b>new</b>", "assets": [{}, {}], "author": {"login": "me"}}')
    assert (r.key, r.title, r.timestamp, r.summary, r.assets, r.author) == ("u", "v1", "2024-03-05T10:00:00Z", "new", 2, "me")
    r = one("issue", '{"id": 5, "title": "t", "labels": [{"name": "bug"}], "pull_request": {}, "created_at": "2024-03-05T10:00:00Z"}')
    assert (r.key, r.labels, r.pull_request) == ("5", ["bug"], True)
    r = one("mastodon", '{"url": "u", "content": "<p>Hello world, this is a long post</p>", "reblog": {"url": "v", "content": "<p>Inner post of another person</p>", "account": {"acct": "b"}}, "account": {"acct": "a"}, "tags": [{"name": "x"}]}')
    assert (r.key, r.author, r.shared_by, r.tags, r.title) == ("v", "b", "a", ["#x"], "Inner post of another person")
    r = one("youtube", '{"snippet": {"title": "T", "resourceId": {"videoId": "z"}, "publishedAt": "2024-03-05T10:00:00Z"}}')
    assert r.key.endswith("v=z")
    assert posts.shaped(spark.createDataFrame([("{}",), ("no",), (None,)], "payload string"), "youtube").count() == 0


def test_jetstream(spark):
    m = lambda text, lang, **k: '{"kind": "commit", "did": "d", "time_us": 1700000000000000, "commit": {"operation": "create", "collection": "app.bsky.feed.post", "rkey": "r", "record": {"text": "%s", "langs": ["%s"]%s}}}' % (text, lang, k.get("more", ""))
    df = spark.createDataFrame([(m("a Lamp #Big", "en-US"),), (m("a lamp", "de"),), (m("lamps", "en"),), (m("lamp", "en", more=', "reply": {}'),)], "payload string")
    rows = posts.jetstream(df, ["lamp"], ["en"]).collect()
    assert [(r.text, r.tags, r.timestamp, len(r.author_key)) for r in rows] == [("a Lamp #Big", ["#big"], "2023-11-14T22:13:20Z", 16)]


def test_forms(spark):
    d = "<a><entityName>ACME FUND OF OHIO</entityName><totalAmountSold>2500000</totalAmountSold><industryGroupType>Pooled Investment Fund</industryGroupType><investmentFundType>Hedge Fund</investmentFundType></a>"
    r = forms.private_raises(spark.createDataFrame([(d,), (d.replace("<a>", "<a><isAmendment>true</isAmendment>"),)], "body string")).collect()
    assert [x.title for x in r] == ["Acme Fund of Ohio reported raising $2.5M privately (hedge fund, Form D)"]
    h = "<n:reportType>13F HOLDINGS REPORT</n:reportType><n:filingManager><n:name>BIG CAPITAL</n:name></n:filingManager><tableValueTotal>5000000</tableValueTotal><tableEntryTotal>{}</tableEntryTotal><reportCalendarOrQuarter>06-30-2024</reportCalendarOrQuarter>"
    r = forms.holdings(spark.createDataFrame([(h.format(10),), (h.format(100000),)], "body string")).collect()
    assert [(x.manager, x.quarter, x.positions) for x in r] == [("Big Capital", "2024 Q2", 10)]
    e = forms.company_events(spark.createDataFrame([(1, ["9.01", "2.02"]), (2, ["9.01"])], "id int, items array<string>"), ["1.05", "2.02"])
    assert [(x.id, x.item) for x in e.collect()] == [(1, "2.02")]


def test_chain_words(spark):
    word = hex(3 * 10**18)[2:].rjust(64, "0")
    r = spark.createDataFrame([("0x" + "0" * 64 + word,)], "d string")
    assert r.select(records.amount(records.word_at(r.d, 1), 18)).first()[0] == 3.0


def test_questions(spark):
    today = date(2024, 6, 1)
    assert answers.terms("What are the biggest crypto hacks of last year?") == ["crypto", "hacks"]
    assert answers.period("rules in march 2023", today) == ("2023-03", "2023-03") and answers.period("last year", today) == ("2023-01", "2023-12")
    assert answers.period("python 2027 roadmap", today) is None and answers.period("biggest ever", today) == ("1800-01", "2024-06")
    assert answers.days("news this week") == 8 and answers.needed(["a"] * 5) == 3 and answers.superlative("the lowest rate") == "least"
    assert answers.picked("USE 2, 9 1", 3) == [2, 1] and answers.picked("NONE", 3) == [] and answers.picked("well", 3) is None
    assert answers.sentence("Dr. Who came. He left.") == "Dr. Who came."
    items = spark.createDataFrame([("k1", "hacks", "Ronin Bridge: $624M lost", "Keys stolen.", "2022-03-29"), ("k2", "hacks", "Small bridge: $5M lost", "", "2023-05-01")], "key string, feed string, title string, summary string, date string")
    assert answers.answer(items, "biggest bridge hacks", today) == "2 sources: Ronin Bridge: $624M lost [1]; Small bridge: $5M lost [2]"
    assert answers.answer(items, "bridge hacks in 2023", today) == "Small bridge: $5M lost, 2023-05-01 [1]"
    assert answers.answer(items, "bridge hacks", today, decide=lambda q, rows: "NONE").startswith("None of the sources")


def test_pages_are_parsed_in_slices(spark):
    """However many pages a batch has, a task holds the parsed ones of a slice."""
    import pandas as pd

    class Frame:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    run = html.pages(Frame(), "u", "h")
    part = pd.DataFrame({"url": [f"http://e.org/{i}" for i in range(600)], "html": ["<p>a b</p>"] * 599 + [None]})
    got = list(run(iter([part])))
    assert max(map(len, got)) <= html.SLICE and [u for x in got for u in x["url"]] == part["url"].tolist()
