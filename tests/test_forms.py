"""Word forms, sizes, typo repair, nearest vectors, nested changes, anchors of questions and feed documents."""

import random
from xml.etree import ElementTree

import pytest

from eventloom.functions import text as X
from eventloom.operators import catalog, core, joins, learn, search
from eventloom.sources import records, sinks


def test_both_forms_of_the_stem_agree(spark):
    words = "places houses stories companies company dies wing passed passing crisis news class series boxes crashes buses use cities Ünder tying needed hacks a".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(X.stem(df.w)).collect()] == [X.stem_of(w) for w in words]
    assert [X.stem_of(w) for w in ("places", "houses", "stories", "passed")] == ["place", "hous", "stor", "pass"]


def test_word_forms(spark):
    texts = "a place|he bought it|the hacker news site|two hackers|under way|United Nations|gold|goldman|Thackeray|EPA rules|epaulet|the Environmental Protection Agency|vulnerabilities".split("|")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda w: [r.t for r in df.filter(search.has(w, df.t)).collect()]
    assert found("places") == ["a place"] and found("buys") == ["he bought it"] and found("hack") == ["two hackers"]
    assert found("un") == ["United Nations"] and found("gold") == ["gold"] and found("flaws") == ["vulnerabilities"]
    assert found("epa") == ["EPA rules", "the Environmental Protection Agency"]


def test_sizes_with_scale(spark):
    titles = ["Index: 4.3B in deposits", "Year: 2024 report 7K", "Storm kills at least 1,241 people", "no number", None, "A $5M and $2B deal", "killed 12 pigs"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(X.size(df.t)).collect()] == [4.3e9, 7e3, None, None, None, 2e9, None]
    assert [r[0] for r in df.select(X.notable(df.t)).collect()][2:6] == [1241e7, None, None, 2e9]


def test_repair_is_complete(spark):
    r = random.Random(3)
    vocab = list({"".join(r.choice("abc") for _ in range(r.randint(4, 11))) for _ in range(300)})
    asked = ["".join(r.choice("abc") for _ in range(r.randint(4, 11))) for _ in range(200)]
    v = spark.createDataFrame([(w, i) for i, w in enumerate(vocab)], "word string, n long")
    got = {x.word: x.fixed for x in search.repair(spark.createDataFrame([(w,) for w in asked], "word string"), v).collect()}
    want = {}
    for w in set(asked) - set(vocab):
        most = 2 if len(w) >= 9 else 1
        near = [(i, x) for i, x in enumerate(vocab) if search.edits(w, x, most) <= most]
        if len(w) >= 5 and near:
            want[w] = max(near)[1]
    assert got == want


def test_nearest_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    df = spark.createDataFrame([(i, [r.random() for _ in range(8)], i % 3) for i in range(60)], "vec_id long, embedding array<double>, label int")
    rows = lambda: sorted(map(tuple, search.nearest(df, df.filter("vec_id % 5 = 0"), 4).select("query_id", "rank", "vec_id", "similarity").collect()))
    whole = rows()
    monkeypatch.setattr(search, "BLOCK", 5)
    assert rows() == whole and len(whole) == 48


def test_diff_of_nested_fields(spark):
    s = "k string, v struct<a:int,b:struct<c:int,d:string>>, l array<int>"
    old = spark.createDataFrame([("x", (1, (2, "p")), [1]), ("y", (1, (2, "p")), [1])], s)
    new = spark.createDataFrame([("x", (1, (3, "p")), [1]), ("y", (1, None), [2])], s)
    got = {r.k: [(f["path"], f["old"], f["new"]) for f in r.fields] for r in core.diff(old, new, "k", ("v", "l")).collect()}
    assert got == {"x": [("v.b.c", "2", "3")], "y": [("v.b.c", "2", None), ("v.b.d", "p", None), ("l", "[1]", "[2]")]}


def test_differences_of_json(spark):
    cases = [
        ('{"a":1,"b":{"c":[1,2]}}', '{"b":{"c":[1,3]},"a":1}', [("b.c", "[1,2]", "[1,3]")]),
        ('{"l":[{"x":1},{"x":2}]}', '{"l":[{"x":1},{"x":3,"y":null}]}', [("l.1.x", "2", "3")]),
        ('{"l":[{"x":1}]}', '{"l":[{"x":1},{"x":2}]}', [("l", '[{"x":1}]', '[{"x":1},{"x":2}]')]),
        ('{"a":{"b":1}}', '{"a":"s"}', [("a", '{"b":1}', "s")]),
        ('{"a":null}', "{}", []), ('{"a":1}', '{"a":1.0}', []), ("[1]", "[2]", [("value", "[1]", "[2]")]), (None, '{"a":"é"}', [("value", None, '{"a":"é"}')]), (None, None, []), ("no json", "no json", []), ("no json", "1", [("value", "no json", "1")]), ("{}", '{"":{"z":[]}}', [("value", None, '{"z":[]}')]),  # an empty name alone has no path
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", core.differences(df.a, df.b).alias("c")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(cases)}


def test_diff_of_variants(spark):
    v = lambda rows: spark.createDataFrame(rows, "k string, s string, n int").selectExpr("k", "try_parse_json(s) as v", "n")
    old, new = v([("a", '{"x":{"y":1}}', 1), ("b", '{"x":1}', 1), ("c", None, 1), ("d", "[]", 1)]), v([("a", '{"x":{"y":2,"z":3}}', 1), ("b", '{"x":1}', 2), ("c", "{}", 1), ("e", "[]", 1)])
    got = {r.k: (r.change, r.fields and [tuple(f) for f in r.fields]) for r in core.diff(old, new, "k", ("v", "n")).collect()}
    assert got == {"a": ("modified", [("v.x.y", "1", "2"), ("v.x.z", None, "3")]), "b": ("modified", [("n", "1", "2")]), "c": ("modified", [("v", None, "{}")]), "d": ("removed", None), "e": ("added", None)}
    assert {r.k for r in core.diff(old, new, "k", ("v",), ignore=("v.x.y", "v.x.z"), only=("modified",)).collect()} == {"c"}


def test_feed_documents(spark):
    items = spark.createDataFrame([(str(i), f"T & {i}", f"https://e.org/?a={i}&b=2", None, "2024-01-02T00:00:00Z") for i in range(1200)], "id string, title string, link string, summary string, date string")
    assert len(ElementTree.fromstring(sinks.atom(items, "t", "l")).findall("{http://www.w3.org/2005/Atom}entry")) == 1200
    assert len(ElementTree.fromstring(sinks.rss(items, "t", "l")).findall("channel/item")) == 1200
    assert sinks.pretty(items.limit(1)).splitlines()[0] == "T & 0"


def test_texts_that_were_decoded_twice(spark):
    broken = lambda t: t.encode().decode("cp1252")
    bad = ["CAFÉ", broken("São"), broken("it’s"), "SÃO PAULO", None, "Ãx", "日本".encode().decode("latin-1"), "voilà " + broken("été"), "Ã" + broken("é"), "", broken("“é”"[1:2]) * 3 + "à", "Ã©Ã", "aÃ\x83Â©"]
    want = ["CAFÉ", "São", "it’s", "SÃO PAULO", None, "Ãx", "日本", "voilà été", "Ãé", "", "éééà", "éÃ", "aÃ©"]
    df = spark.createDataFrame([(t,) for t in bad], "t string")
    assert [r[0] for r in df.select(X.repaired(df.t)).collect()] == want


def test_titles_of_the_archive(spark):
    rows = {"Ha&#039;apai &amp;amp; &#x1F600; &eacute;&nbsp;&bogus; &#0; &#xD800; AT&T": "Ha'apai & \U0001f600 é\xa0&bogus; &#0; &#xD800; AT&T", "He said Â€œhiÂ€\x9d, itÏ¿½s CROMATOGRAFÃ\x8dA": "He said “hi”, it’s CROMATOGRAFÍA", "&lt;b&gt;": "<b>", "&;&#;&": "&;&#;&"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(X.archive_title(df.t)).collect()] == list(rows.values())


def test_quakes_of_four_agencies(spark):
    one = lambda body: spark.createDataFrame([(body,)], "body string")
    emsc = records.emsc_quakes(one('{"action":"create","data":{"properties":{"unid":"u","mag":5.1,"lat":9.5,"lon":138.1,"time":"2024-01-01T00:00:01Z","flynn_region":"STATE OF YAP, MICRONESIA"}}}')).first()
    assert (emsc.agency, emsc.id, emsc.t, emsc.place, emsc.title) == ("EMSC", "u", 1704067201.0, "State of Yap, Micronesia", "M 5.1 - State of Yap, Micronesia")
    assert records.emsc_quakes(one('{"action":"delete"}')).count() == 0
    report = '{"eid":"%s","at":"2024-01-01T16:10:00+09:00","en_ttl":"%s","cod":"+37.5+137.3-10000/","mag":"%s","maxi":"%s","en_anm":"Noto"}'
    rows = [("1", "Earthquake Information", "7.6", "7"), ("1", "Earthquake Information", "7.4", ""), ("2", "Earthquake", "2.0", "1"), ("3", "Distant Earthquake", "8.0", ""), ("4", "Earthquake", "3.0", "5-")]
    got = sorted(tuple(r)[1:7] for r in records.jma_quakes(one("[" + ",".join(report % r for r in rows) + "]"), 4.0).collect())
    assert got == [("1", 1704093000.0, 37.5, 137.3, 7.6, "M 7.6 - Noto, Japan (JMA intensity 7)"), ("4", 1704093000.0, 37.5, 137.3, 3.0, "M 3.0 - Noto, Japan (JMA intensity 5 lower)")]
    gfz = records.gfz_quakes(one("#head\ng1|2024-01-01T00:00:00|1.5|2.5|10|||||Mw|6.2||Sea|earthquake\nbad|line")).collect()
    assert [tuple(r)[:8] for r in gfz] == [("GFZ", "g1", 1704067200.0, 1.5, 2.5, 6.2, "M 6.2 - Sea", "Sea")]


def test_word_vectors_and_readout(spark):
    texts = [["cat", "sat", "mat"], ["dog", "sat", "mat"], ["cat", "ran"], ["dog", "ran"]] * 10
    pairs = learn.ppmi(spark.createDataFrame([(t,) for t in texts], "words array<string>"), least=5)
    v = {r.word: r.vector.toArray() for r in learn.word_vectors(pairs, dims=2).collect()}
    assert set(v) == {"cat", "dog", "sat", "mat", "ran"} and abs(v["cat"] - v["dog"]).max() < 1e-9
    rows = learn.tfidf(spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", float(i % 2)) for i in range(20)], "doc_id long, text string, label double"), 64)
    assert all(r.prediction == r.label for r in learn.readout(rows, rows).collect())


def test_clusters_against_plain_loops(spark):
    r = random.Random(6)
    rows = [(i, r.randrange(3), float(r.randrange(3000)), r.uniform(0, 12), r.uniform(0, 12)) for i in range(150)] + [(900, 0, 1e6, 0.0, 0.0), (901, 1, 1e6 + 120, 0.0, 3.0), (902, 2, 1e6 + 121, 0.0, 0.0)]
    heads, want = [], {}
    for i, _, t, lat, lon in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        own = next((h for h in heads if abs(h[1] - t) <= 120 and joins._km(h[2], h[3], lat, lon) <= 400), None)
        if own is None:
            heads.append((i, t, lat, lon))
        want[i] = own[0] if own else i
    df = spark.createDataFrame(rows, "id long, priority int, t double, lat double, lon double").repartition(3)
    for span in (3600, 250, 120):  # spans that cut the dense stream, in which no gap is over 120 s
        assert {x.id: x.cluster for x in joins.clusters(df, span=span).collect()} == want and len(heads) < 140
    assert joins.clusters(df.limit(0)).count() == 0 and joins.clusters(df).columns == [*df.columns, "cluster"]
    with pytest.raises(ValueError, match="span"):
        joins.clusters(df, span=60)


def test_nearest_against_plain_loops(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)], r.choice(["a", None, "b"])) for i in range(80)] + [(200, None, "x"), (201, [1.0, None, 2.0], "x"), (202, [0.0, 0.0, 0.0], "x"), (203, [1.0, 2.0], "x"), (5, [1.0, 1.0, 1.0], "twice")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    usable = [(i, v) for i, v, _ in rows if v and len(v) == 3 and None not in v and any(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for least in (None, 0.5):
        want = set()
        for q, a in usable:
            if q % 10 == 0:
                near = sorted((-round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 6), i) for i, b in usable if i != q)
                want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(x for x in near if least is None or -x[0] >= least) if n < 4}
        for cells in (search.CELLS, 40):
            kept, search.CELLS = search.CELLS, cells
            try:
                got = search.nearest(df, df.filter("vec_id % 10 = 0"), 4, least).collect()
            finally:
                search.CELLS = kept
            assert {(x.query_id, x.vec_id, x.similarity, x["rank"]) for x in got} == want
    assert search.nearest(df, df.limit(0)).count() == 0 and search.nearest(df.limit(0), df).count() == 0
