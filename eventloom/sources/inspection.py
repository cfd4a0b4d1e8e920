"""What an address offers, and how it is best read: one row of checks for each body."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import Page
from .selectors import Selectors, Tree, _walk

#: Ids of the element that scripts fill, and how few words a page has that shows nothing without them.
ROOTS = ("root", "app", "__next", "__nuxt", "svelte")
READABLE, SCARCE, SCRIPTS = 80, 30, 3

SCHEMA = "url string, kind string, title string, written string, words int, types array<string>, products int, method string, feeds array<string>, needs_scripts boolean"


def _types(bodies: list[str]) -> list[str]:
    """The @type values of JSON-LD, in order, graphs and lists opened."""
    found: dict[str, None] = {}
    todo: list = []
    for body in bodies:
        try:
            todo.append(json.loads(body))
        except ValueError:
            continue
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            kinds = x.get("@type")
            found |= dict.fromkeys(str(k) for k in (kinds if isinstance(kinds, list) else [kinds]) if k)
            todo = (x["@graph"] if isinstance(x.get("@graph"), list) else []) + todo
    return list(found)


def needs_scripts(html: str, words: int) -> bool:
    """Hardly any text without a browser: the root that scripts fill is empty, or there are scripts and next to no words."""
    if words >= READABLE:
        return False
    tree, table = Tree(html), Selectors()
    root, script = table.add(", ".join(f"[id='{x}']" for x in ROOTS)), table.add("script")
    table.match(tree)
    first = next((i for i, n in enumerate(tree.nodes) if n.steps & root), None)
    return (first is not None and not tree.text(first)) or (words < SCARCE and sum(bool(n.steps & script) for n in tree.nodes) >= SCRIPTS)


def _written(body: str) -> str:
    """The title as it stands between its tags, references unread, with single spaces."""
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", body)
    return re.sub(r"[\t\n\f\r ]+", " ", found[1]).strip(" ") if found else ""


def _row(url: str, body: str) -> tuple:
    head = body.lstrip()[:500].lower()
    if head[:1] in ("{", "["):
        try:
            json.loads(body)
            return (url, "json", None, _written(body), 0, [], 0, None, [], False)
        except ValueError:
            pass
    if "<rss" in head or "<feed" in head:
        return (url, "feed", None, _written(body), 0, [], 0, None, [], False)
    page = Page(body, url)
    words, found = len(page.text.split()), page.products()
    types = _types(page.json)
    method = None if not found else "json-ld" if "Product" in types else "opengraph"
    return (url, "page", " ".join(page.title.split()), _written(body), words, types, len(found), method, page.feeds, needs_scripts(body, words))


def inspect(df: DataFrame) -> DataFrame:
    """df (url, html: the body, whatever it is) as url, kind (json, feed, page), title, written (the title with its references unread), words, types, products, method,
    feeds, needs_scripts, checks (name, ok, detail) and suggestions (what to read it with, best first). A null body is an empty page."""
    x = _walk(df, SCHEMA, lambda url, body: [_row(url, body)])
    check = lambda name, ok, yes, no: F.struct(F.lit(name).alias("name"), ok.alias("ok"), F.when(ok, yes).otherwise(no).alias("detail"))
    page = F.col("kind") == "page"
    some = lambda c: F.size(c) > 0
    of_page = F.array(
        check("JSON-LD", some("types"), F.array_join(F.slice("types", 1, 6), ", "), F.lit("none")),
        check("Products", F.col("method").isNotNull(), F.concat(F.lit("found by "), F.col("method")), F.lit("none")),
        check("Feeds", some("feeds"), F.array_join(F.slice("feeds", 1, 3), ", "), F.lit("none advertised")),
        check("Readable", ~F.col("needs_scripts"), F.concat("words", F.lit(" words without scripts")), F.concat(F.lit("only "), "words", F.lit(" words without scripts"))),
    )
    checks = F.when(page, of_page).otherwise(F.array(F.struct(F.col("kind").alias("name"), F.lit(True).alias("ok"), F.concat(F.lit("the body is "), F.col("kind")).alias("detail"))))
    only = lambda test, *what: F.when(test, F.array(*[F.lit(w) if isinstance(w, str) else w for w in what])).otherwise(F.array().cast("array<string>"))
    plain = page & ~F.col("needs_scripts") & F.col("method").isNull()
    suggestions = F.concat(
        only(F.col("kind") == "json", "files.read"), only(F.col("kind") == "feed", "feeds.entries"), only(page & F.col("method").isNotNull(), "html.pages: products, then diff"),
        only(page & some("feeds"), F.concat(F.lit("feeds.entries of "), F.get("feeds", F.lit(0)))), only(page & F.col("needs_scripts"), "render it first"), only(plain, "html.pages", "selectors.records"),
    )
    return x.withColumns({"checks": checks, "suggestions": suggestions})
