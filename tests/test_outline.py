"""Nested lists against a plain recursive walk, and news pages."""

import random

from eventloom.sources import outline as O


def nested(r, depth=0):
    """A list and its leaves: (path, text)."""
    html, leaves = "", []
    for _ in range(r.randint(1, 3)):
        label = f"t{r.randint(0, 99)}"
        if depth < 3 and r.random() < 0.4:
            inner, below = nested(r, depth + 1)
            html += f"<li><b>{label}</b> {inner}</li>"
            leaves += [([label, *p], t) for p, t in below]
        else:
            html += f"<li>{label} <i>x</i></li>"
            leaves.append(([], f"{label} x"))
    tag = r.choice(["ul", "ol"])
    return f"<{tag}>{html}</{tag}>", leaves


def test_leaves_against_a_plain_walk(spark):
    r = random.Random(1)
    pages = [nested(r) for _ in range(40)]
    two = [(f"u{i}", f"<div>{h}</div><p>z</p>{pages[i - 1][0]}", leaves + pages[i - 1][1]) for i, (h, leaves) in enumerate(pages)]
    df = spark.createDataFrame([(u, h) for u, h, _ in two] + [("none", None), ("empty", "<ul></ul>")], "url string, html string")
    got = {}
    for x in O.outline(df).orderBy("url", "n").collect():
        got.setdefault(x.url, []).append((x.path, x.text))
    assert got == {u: leaves for u, _, leaves in two}


def test_news_pages(spark):
    day = lambda label, body: f'<div class="current-events-main vevent" {label}><div class="current-events-content description">{body}</div></div>'
    body = '<p><b>Disasters and accidents</b></p><ul><li>Storms<ul><li>Storm one<ul><li>A ship sinks in the harbour of a town<sup>[1]</sup> , and ten are saved. <a class="external" href="https://n.org/a">(Daily News)</a></li></ul></li></ul></li><li>Too short</li></ul><p>' + "x" * 70 + "</p><ul><li>Another event that is long enough to be told; </li></ul>"
    long = "<ul><li>" + "First sentence " * 10 + "ends. " + "Second one goes on " * 20 + "</li></ul>"
    html = day('id="2024_March_5"', body) + day('aria-label="2024-03-06"', long) + day("", body) + '<div class="current-events-main" id="2024_March_7"></div>'
    got = O.current_events(spark.createDataFrame([("https://w.org/p", html), (None, None)], "url string, html string")).orderBy("day", "n").collect()
    assert [(x.day, x.category, x.topic) for x in got] == [("2024-03-05", "Disasters and accidents", ["Storms", "Storm one"]), ("2024-03-05", "Disasters and accidents", []), ("2024-03-06", "", [])]
    assert got[0].text == "A ship sinks in the harbour of a town, and ten are saved." and [tuple(s) for s in got[0].sources] == [("Daily News", "https://n.org/a")]
    assert got[1].title == "Another event that is long enough to be told" and got[2].title == ("First sentence " * 10).strip() + " ends."
    assert O.current_events(spark.createDataFrame([("u", html)], "url string, html string"), days=["2024-03-06"]).count() == 1
