"""CSS selectors against a matcher that follows the definitions, on random pages."""

import random

import pytest

from eventloom.sources import selectors as S

TAGS, CLASSES = ["div", "p", "a", "li", "b"], ["x", "y", "z"]


def page(r, depth=0):
    out = ""
    for _ in range(r.randint(0, 4 if depth < 4 else 0)):
        tag = r.choice(TAGS[:1] + TAGS[2:3] + TAGS[4:]) if depth else r.choice(["div", "b"])
        attrs = ""
        if r.random() < 0.6:
            attrs += f' class="{" ".join(r.sample(CLASSES, r.randint(1, 2)))}"'
        if r.random() < 0.3:
            attrs += f' href="/{r.choice("abc")}-{r.randint(1, 3)}"'
        if r.random() < 0.1:
            attrs += f' id="i{r.randint(1, 3)}"'
        out += f"<{tag}{attrs}>{r.choice(['', 't ', ' '])}{page(r, depth + 1)}</{tag}>"
    return out


def one(r):
    s = r.choice(["", "div", "a", "b", "*"])
    s += r.choice(["", "", ".x", ".y.z", "[href]", '[href^="/a"]', "[class~=x]", "[href$='2' i]", "#i1", ":nth-child(2n+1)", ":nth-child(2)", ":first-child", ":last-of-type", ":nth-last-child(-n+2)", ":not(.x)", ":is(a, .y)", ":empty", ":only-child", ":nth-of-type(even)"])
    return s or "*"


def holds(tree, i, parts):
    """parts: compound, (combinator, compound), ... ; from the right, trying every place."""
    (how, compound), before = parts[-1], parts[:-1]
    own = S.Selectors()
    own.add(compound)
    if not all(t(tree, i) for t in own.steps[0].tests):
        return False
    if not before:
        return True
    n = tree.nodes[i]
    brothers = [j for j, m in enumerate(tree.nodes) if j and m.parent == n.parent and m.place < n.place]
    up, p = [], n.parent
    while p > 0:
        up.append(p)
        p = tree.nodes[p].parent
    places = {" ": up, ">": up[:1], "~": brothers, "+": brothers[-1:]}[how]
    return any(holds(tree, j, before) for j in places)


def test_selectors_against_definitions():
    r = random.Random(5)
    found = 0
    for _ in range(150):
        tree = S.Tree(page(r))
        table, wanted = S.Selectors(), []
        for _ in range(6):
            alternatives = []
            for _ in range(r.choice([1, 1, 2])):
                parts = [("", one(r))]
                for _ in range(r.randint(0, 3)):
                    parts.append((r.choice([" ", ">", "+", "~"]), one(r)))
                alternatives.append(parts)
            css = ", ".join("".join((h if h == " " else f" {h} ") + c if h else c for h, c in parts) for parts in alternatives)
            wanted.append((css, alternatives, table.add(css)))
        table.match(tree)
        for css, alternatives, ends in wanted:
            got = [i for i, n in enumerate(tree.nodes) if n.steps & ends]
            assert got == [i for i in range(1, len(tree.nodes)) if any(holds(tree, i, p) for p in alternatives)], css
            found += len(got)
    assert found > 1000


def test_places_and_attributes_by_hand():
    tree = S.Tree('<ul><li>1<li class="A b">2<br>x<li data-k="v w">3</ul><p>a<p>b<table><tr><td>c<td>d<tr><td>e</table><img src=q><script>n</script><p hidden lang="en-US"></p>')
    text = lambda css: _find(tree, css)
    assert text("li:nth-child(2)") == ["2 x"] and text("li:nth-last-child(1)") == ["3"] and text("li.b.A") == ["2 x"] and text("li.a") == []
    assert text("[data-k~=w]") == ["3"] and text("[data-k=v]") == [] and text('[lang|="en"]') == [""] and text("[CLASS='a B' i]") == ["2 x"]
    assert text("tr:first-child > td + td") == ["d"] and text("p ~ table td") == ["c", "d", "e"] and text("p:empty") == [""] and text("td, li:nth-child(odd)") == ["1", "3", "c", "d", "e"]
    assert text("script") == ["n"] and "n" not in tree.text(0) and text("p:not([hidden])") == ["a", "b"]
    for bad in ("", "a >", "> a", "a,,b", "li:nth-child(x)", ":hover", "a[", "p:not(a b)", "a!b", "li:nth-child(2", ".x div.y*"):
        with pytest.raises(S.SelectorError):
            S.Selectors().add(bad)


def _find(tree, css):
    table = S.Selectors()
    ends = table.add(css)
    for n in tree.nodes:
        n.steps = 0
    table.match(tree)
    return [tree.text(i) for i, n in enumerate(tree.nodes) if n.steps & ends]


def test_operators(spark):
    html = '<div class=q><h2>One</h2><a href="/1">go</a></div><div class=q><h2>Two</h2><a href="http://x.org/2?a=1&amp;b=2">on</a></div><div class=q></div><a rel=next href="?p=2">more</a>'
    df = spark.createDataFrame([("http://e.org/l/", html, 1), ("http://e.org/n", "<p>none</p>", 2), (None, None, 3)], "url string, html string, n int")
    got = S.records(df, {"title": "h2", "link": "a@href", "kind": "@class"}, each="div.q").collect()
    assert [tuple(x) for x in got] == [("http://e.org/l/", 0, "One", "http://e.org/1", "q"), ("http://e.org/l/", 1, "Two", "http://x.org/2?a=1&b=2", "q"), ("http://e.org/l/", 2, None, None, "q")]
    assert [tuple(x) for x in S.records(df, {"first": "h2", "odd name": "p"}).collect()] == [("http://e.org/l/", 0, "One", None), ("http://e.org/n", 0, None, "none")]
    e = S.elements(df, "div > a").collect()
    assert [(x.n, x.tag, x.text, x.link) for x in e] == [(0, "a", "go", "http://e.org/1"), (1, "a", "on", "http://x.org/2?a=1&b=2")] and e[0].attrs == {"href": "/1"}
    assert [tuple(x) for x in S.next_pages(df, "a[rel~=next]").collect()] == [("http://e.org/l/", "http://e.org/l/?p=2")]
    assert [tuple(x)[1:] for x in S.matched(df, {"d": "div", "a": "div a, p"}).collect()] == [(3, 2), (0, 1), (0, 0)] and S.elements(df.limit(0), "a").count() == 0
