"""Nested lists as rows: each innermost item with the topics that lead to it; and the day pages of an encyclopedia's news made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selectors import Selectors, Tree, _walk

LISTS = ("ul", "ol")
#: An event's sentence has so many letters at least, a heading fewer than so many; titles are cut at a length, at a sentence's end if one is late enough.
SENTENCE, HEADING, TITLE, EARLIEST = 25, 60, 300, 80
LEAF = "path array<string>, text string, links array<struct<text:string,url:string>>"


def _children(tree: Tree, at: int) -> list[int]:
    out, i = [], at + 1
    while i < tree.nodes[at].end:
        out.append(i)
        i = tree.nodes[i].end
    return out


def _text(tree: Tree, at: int, without: list[int]) -> str:
    """Text of an element but for some elements in it, each piece apart."""
    gone = [(i, tree.nodes[i].end) for i in without]
    pieces = (p for i, p in tree.pieces if at <= i < tree.nodes[at].end and not any(a <= i < b for a, b in gone))
    return re.sub(r"\s+", " ", " ".join(pieces)).strip()


def _leaves(tree: Tree, start: int) -> list[tuple[list[str], int]]:
    """The innermost items of a list in the order of the page, each with the labels of the items around it."""
    out, todo = [], [([], start)]
    while todo:
        path, at = todo.pop()
        if tree.nodes[at].tag == "li":
            nested = [c for c in _children(tree, at) if tree.nodes[c].tag in LISTS]
            if not nested:
                out.append((path, at))
                continue
            below = [([*path, _text(tree, at, nested)], c) for c in nested]
        else:
            below = [(path, c) for c in _children(tree, at) if tree.nodes[c].tag == "li"]
        todo += reversed(below)
    return out


def _leaf(tree: Tree, at: int, links: set[int], drop: set[int], url: str) -> tuple[str, list[tuple]]:
    inside = range(at + 1, tree.nodes[at].end)
    found = [i for i in inside if i in links]
    named = [(_text(tree, i, []), tree.value(i, "href", url)) for i in found]
    return _text(tree, at, [i for i in inside if i in drop]), [(t, u) for t, u in named if t and u]


def outline(df: DataFrame, within: str = "ul, ol") -> DataFrame:
    """url, n, path, text, links of each innermost item of the outermost lists that `within` finds: path holds the labels of the items that lead to
    it (their text without the lists in them), outermost first. Items of lists in one another have one row; a null page has none."""
    table = Selectors()
    ends, a = table.add(within), table.add("a[href]")

    def rows(url: str, html: str) -> list[tuple]:
        tree = Tree(html)
        table.match(tree)
        links, out, done = {i for i, n in enumerate(tree.nodes) if n.steps & a}, [], 0
        for i, n in enumerate(tree.nodes):
            if n.steps & ends and n.tag in LISTS and i >= done:
                done = n.end
                out += [(path, *_leaf(tree, at, links, set(), url)) for path, at in _leaves(tree, i)]
        return [(url, k, *r) for k, r in enumerate(out)]

    return _walk(df, f"url string, n int, {LEAF}", rows)


def _title(c: Column) -> Column:
    c = F.regexp_replace(c, "[ ;,]+$", "")
    head = F.substring(c, 1, TITLE)
    last = F.length(head) - F.length(F.substring_index(head, ". ", -1)) - 1  # where the last sentence that fits ends
    short = F.when((last > EARLIEST) & head.contains(". "), F.substr(c, F.lit(1), last)).otherwise(F.concat(F.rtrim(F.substring(c, 1, TITLE - 1)), F.lit("…")))
    return F.when(F.length(c) <= TITLE, c).otherwise(short)


def current_events(df: DataFrame, region: str = "div.current-events-main", content: str = ".current-events-content", days: list[str] | None = None) -> DataFrame:
    """day, n, category, topic, title, text, sources (name, url) of each event on pages of news by day.

    A region is a day, named by its label or id; its lists hold events, under the heading before them (category) and the items around them (topic).
    Reference marks and links to sources are no part of a sentence; shorter ones than an event has are left out."""
    table = Selectors()
    regions, contents = table.add(region), table.add(content)
    external, marks = table.add("a.external"), table.add("sup")

    def rows(url: str, html: str) -> list[tuple]:
        tree = Tree(html)
        table.match(tree)
        bits = [n.steps for n in tree.nodes]
        links, drop = {i for i, b in enumerate(bits) if b & external}, {i for i, b in enumerate(bits) if b & (external | marks)}
        out = []
        for r in (i for i, b in enumerate(bits) if b & regions):
            named = f"{tree.nodes[r].attrs.get('id', '')} {tree.nodes[r].attrs.get('aria-label', '')} {tree.nodes[r].attrs.get('data-date', '')}"
            body = next((i for i in range(r + 1, tree.nodes[r].end) if bits[i] & contents), None)
            category = ""
            for c in _children(tree, body) if body is not None else ():
                if tree.nodes[c].tag in LISTS:
                    for path, at in _leaves(tree, c):
                        text, sources = _leaf(tree, at, links, drop, url)
                        text = re.sub(r"\(\s*\)|\s+(?=[.,;:])", "", text).strip()
                        if len(text) >= SENTENCE:
                            out.append((named, category, path, text, [(t.strip("() "), u) for t, u in sources]))
                elif tree.nodes[c].tag in ("p", "div") and (head := _text(tree, c, [])) and len(head) < HEADING:
                    category = head.capitalize()
        return [(url, k, *x) for k, x in enumerate(out)]

    got = _walk(df, "url string, n int, named string, category string, path array<string>, text string, links array<struct<text:string,url:string>>", rows)
    words = F.regexp_extract("named", r"(\d{4})[-_ ]+([A-Za-z]+)[-_ ]+(\d{1,2})", 0)
    iso = F.regexp_extract("named", r"\d{4}-\d{2}-\d{2}", 0)
    spelt = F.date_format(F.coalesce(*[F.try_to_timestamp(F.regexp_replace(words, "[-_ ]+", " "), F.lit(f)) for f in ("yyyy MMMM d", "yyyy MMM d")]), "yyyy-MM-dd")
    out = got.select("url", F.when(iso != "", iso).otherwise(spelt).alias("day"), "n", "category", F.col("path").alias("topic"), _title(F.col("text")).alias("title"), "text", F.col("links").alias("sources")).filter("day is not null")
    return out.filter(F.col("day").isin(days)) if days is not None else out
