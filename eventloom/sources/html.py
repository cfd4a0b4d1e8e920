"""Pages as rows: text, title, links, headings, tables, products, by one Arrow pass of a standard parser."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "template", "svg", "head"}
BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "pre", "blockquote"}
#: Parsed pages that a task holds at once.
SLICE = 256
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


class Page(HTMLParser):
    """What a page says, gathered in one walk."""

    def __init__(self, html: str, url: str = ""):
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.hidden = url, [], 0
        self.title, self.lang, self.canonical = "", "", ""
        self.links, self.headings, self.tables, self.feeds, self.meta, self.json = [], [], [], [], {}, []
        self._text, self._into = [], None
        self.feed(html or "")
        self.close()

    @property
    def text(self) -> str:
        lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(self._text).split("\n"))
        return "\n".join(x for x in lines if x)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        elif tag == "link":
            if a.get("rel") == "canonical":
                self.canonical = urljoin(self.url, a.get("href", ""))
            elif "alternate" in a.get("rel", "") and re.search("rss|atom|json", a.get("type", "")):
                self.feeds.append(urljoin(self.url, a.get("href", "")))
        elif tag == "a" and "href" in a:
            self.links.append([urljoin(self.url, a["href"]), ""])
        elif re.fullmatch("h[1-6]", tag):
            self.headings.append([int(tag[1]), ""])
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.json.append("")
            self._into = "json"
        if tag in BLOCK:
            self._text.append("\n")
        if tag not in VOID:
            quiet = tag in HIDDEN or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")) is not None
            self.open.append((tag, quiet))
            self.hidden += quiet

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._text.append("\n")
        if tag == "script":
            self._into = None
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, quiet = self.open.pop()
                self.hidden -= quiet
                if t == tag:
                    break

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if self._into == "json":
            self.json[-1] += data
        if "title" in tags and "body" not in tags and "svg" not in tags:
            self.title += data
        if self.hidden:
            return
        self._text.append(data)
        if "a" in tags and self.links:
            self.links[-1][1] += data
        if self.headings and any(re.fullmatch("h[1-6]", t) for t in tags):
            self.headings[-1][1] += data
        if self.tables and self.tables[-1] and self.tables[-1][-1] and ("td" in tags or "th" in tags):
            self.tables[-1][-1][-1] += data

    def records(self) -> list[dict]:
        """Rows of tables as records named by their first row."""
        out = []
        for t in self.tables:
            rows = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in t if r]
            out += [dict(zip(rows[0], r, strict=False)) for r in rows[1:]]
        return out

    def products(self) -> list[dict]:
        """Products of JSON-LD graphs, one for each offer, else of OpenGraph tags."""
        out = []
        for body in self.json:
            try:
                todo = [json.loads(body)]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo += x
                elif isinstance(x, dict):
                    todo += x.get("@graph", []) if isinstance(x.get("@graph"), list) else []
                    if "Product" in (x.get("@type") if isinstance(x.get("@type"), list) else [x.get("@type")]):
                        offers = x.get("offers") or [{}]
                        for o in offers if isinstance(offers, list) else [offers]:
                            out.append({"name": x.get("name"), "sku": o.get("sku") or x.get("sku"), "price": str(o.get("price") or o.get("lowPrice") or ""), "currency": o.get("priceCurrency"), "availability": (o.get("availability") or "").rstrip("/").rpartition("/")[2]})
        if not out and (price := self.meta.get("product:price:amount") or self.meta.get("og:price:amount")):
            out.append({"name": self.meta.get("og:title"), "sku": None, "price": price, "currency": self.meta.get("product:price:currency") or self.meta.get("og:price:currency"), "availability": self.meta.get("product:availability", "")})
        return out


SCHEMA = (
    "url string, title string, lang string, canonical string, text string, links array<struct<url:string,text:string>>, headings array<struct<level:int,text:string>>, "
    "records array<map<string,string>>, feeds array<string>, meta map<string,string>, products array<struct<name:string,sku:string,price:string,currency:string,availability:string>>"
)


def pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page, with all that the parser found."""
    clean = lambda s: re.sub(r"\s+", " ", s).strip()
    names = [f.split()[0] for f in re.sub("<[^ ]*>", "", SCHEMA).split(", ")]

    def run(parts):
        for part in parts:
            rows = []
            for u, h in zip(part["url"], part["html"], strict=True):
                if len(rows) == SLICE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
                p = Page(h or "", u or "")
                rows.append((u, clean(p.title), p.lang, p.canonical, p.text, [(a, clean(b)) for a, b in p.links], [(a, clean(b)) for a, b in p.headings], p.records(), p.feeds, p.meta, [tuple(x.values()) for x in p.products()]))
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, SCHEMA)


def titles(df: DataFrame) -> DataFrame:
    """Titles alone need no parser."""
    return df.select("*", F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")).alias("title"))


def links(df: DataFrame) -> DataFrame:
    """Each page's href values."""
    return df.select("*", F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1).alias("links"))
