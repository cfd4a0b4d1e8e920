"""CSS selectors over pages: elements, records of fields, and the next page.

A selector is compiled to steps; a page is walked once, and each element gets, as bits, the steps that end at it. A step holds where its own
tests do and the step before it holds at the parent, an ancestor, the sibling before or an earlier sibling; so every selector of a query is
matched in one walk without looking back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import HIDDEN, VOID

#: What a start tag closes when it stands right inside it, as its end tag may be left out.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}}
CLOSES |= {tag: {"p"} for tag in "article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Attributes that hold addresses.
ADDRESSES = ("href", "src", "action")


@dataclass
class Node:
    """An element; its descendants are the nodes after it, up to `end`."""

    tag: str
    attrs: dict[str, str]
    parent: int
    place: int
    of_type: int
    end: int = 0
    siblings: int = 0
    same_type: int = 0
    children: dict[str, int] = field(default_factory=dict)
    steps: int = 0


class Tree(HTMLParser):
    """A page as nodes in document order; node 0 is the page itself."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", {}, -1, 0, 0)]
        self.open, self.pieces = [0], []
        self.feed(html or "")
        self.close()
        while self.open:
            self._shut()
        self.filled = {i for i, piece in self.pieces if piece.strip()}
        for n in self.nodes[1:]:
            of = self.nodes[n.parent].children
            n.siblings, n.same_type = of[""], of[n.tag]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and self.nodes[self.open[-1]].tag in CLOSES.get(tag, ()):
            self._shut()
        seen = self.nodes[self.open[-1]].children
        seen[""] = seen.get("", 0) + 1
        seen[tag] = seen.get(tag, 0) + 1
        self.nodes.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1], seen[""], seen[tag]))
        if tag in VOID:
            self.nodes[-1].end = len(self.nodes)
            if tag == "br":
                self.pieces.append((len(self.nodes) - 1, " "))
        else:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut()

    def handle_endtag(self, tag):
        if any(self.nodes[i].tag == tag for i in self.open[1:]):
            while self.nodes[self.open[-1]].tag != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        self.pieces.append((self.open[-1], data))

    def _shut(self):
        self.nodes[self.open.pop()].end = len(self.nodes)

    def text(self, at: int) -> str:
        """Visible text of an element, spaces squeezed."""
        end = self.nodes[at].end
        if not hasattr(self, "hidden"):
            self.hidden = [False] * len(self.nodes)
            for i, n in enumerate(self.nodes[1:], 1):
                self.hidden[i] = n.tag in HIDDEN - {"head"} or self.hidden[n.parent]
        return re.sub(r"\s+", " ", "".join(p for i, p in self.pieces if at <= i < end and (not self.hidden[i] or self.hidden[at]))).strip()

    def value(self, at: int, attribute: str | None, url: str) -> str | None:
        """Text of an element or one of its attributes, addresses made whole; null if there is none."""
        if attribute is None:
            return self.text(at) or None
        got = self.nodes[at].attrs.get(attribute)
        return got if got is None else urljoin(url, got) if attribute in ADDRESSES else got.strip()


# Selectors ----------------------------------------------------------------------------------------------------------

Test = Callable[[Tree, int], bool]
NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
TOKENS = re.compile(rf"""(?P<gap>\s*[>+~,]\s*|\s+)|(?P<id>\#[\w\u0080-\U0010ffff-]+)|(?P<cls>\.{NAME})|(?P<attr>\[\s*(?P<key>{NAME}(?::{NAME})?)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]"']+))\s*(?P<any>[iI])?\s*)?\])|(?P<pseudo>:(?P<what>[a-z-]+)(?P<arg>\()?)|(?P<tag>\*|{NAME})""")
COMPARE: dict[str, Callable[[str, str], bool]] = {
    "=": lambda a, b: a == b,
    "~=": lambda a, b: b != "" and b in a.split(),
    "|=": lambda a, b: a == b or a.startswith(b + "-"),
    "^=": lambda a, b: b != "" and a.startswith(b),
    "$=": lambda a, b: b != "" and a.endswith(b),
    "*=": lambda a, b: b != "" and b in a,
}


class SelectorError(ValueError):
    pass


@dataclass
class Step:
    """Tests of one element, and the bits of one of which (the step before it) must hold where `how` says."""

    how: str
    before: int
    tests: list[Test]


class Selectors:
    """Several selectors as one table of steps; the last step of each of a selector's alternatives ends it."""

    def __init__(self):
        self.steps: list[Step] = []

    def add(self, selector: str) -> int:
        """The bits of the steps that end this selector."""
        ends, at, tests, how, before = 0, 0, [], "", 0
        text = selector.strip()
        if not text:
            raise SelectorError("empty selector")
        while at <= len(text):
            m = TOKENS.match(text, at)
            gap = m["gap"].strip() or " " if m and m["gap"] is not None else ""
            if at == len(text) or gap:
                if not tests:
                    raise SelectorError(f"invalid selector {selector!r} at {at}")
                self.steps.append(Step(how, before, tests))
                bit, tests = 1 << len(self.steps) - 1, []
                how, before = (gap, bit) if gap and gap != "," else ("", 0)
                if at == len(text) or gap == ",":
                    ends |= bit
                if at == len(text):
                    return ends
                at = m.end()
                continue
            if not m:
                raise SelectorError(f"invalid selector {selector!r} at {at}")
            if m["tag"] and tests:
                raise SelectorError(f"invalid selector {selector!r} at {at}")
            test, at = self._test(m, text, selector)
            tests.append(test)
        raise SelectorError(f"invalid selector {selector!r}")

    def _test(self, m: re.Match, text: str, selector: str) -> tuple[Test, int]:
        if m["tag"]:
            tag = m["tag"].lower()
            return (lambda t, i: tag == "*" or t.nodes[i].tag == tag), m.end()
        if m["id"]:
            own = m["id"][1:]
            return (lambda t, i: t.nodes[i].attrs.get("id") == own), m.end()
        if m["cls"]:
            name = m["cls"][1:]
            return (lambda t, i: name in t.nodes[i].attrs.get("class", "").split()), m.end()
        if m["attr"]:
            key, op, want = m["key"].lower(), m["op"], m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else m["bare"] or ""
            if not op:
                return (lambda t, i: key in t.nodes[i].attrs), m.end()
            fold = str.lower if m["any"] else str
            return (lambda t, i: key in t.nodes[i].attrs and COMPARE[op](fold(t.nodes[i].attrs[key]), fold(want))), m.end()
        what, arg, at = m["what"], None, m.end()
        if m["arg"]:
            depth, end = 1, at
            while end < len(text) and depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            if depth:
                raise SelectorError(f"invalid selector {selector!r}: ')' is missing")
            arg, at = text[at : end - 1].strip(), end
        return _pseudo(what, arg, selector), at

    def match(self, tree: Tree) -> None:
        """Set each node's steps. A node's bits, those of its ancestors, of the sibling before it and of all earlier ones decide what may follow."""
        nodes = tree.nodes
        above, last, earlier = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)  # by node: of it and its ancestors; of its last child and all children so far
        for i, n in enumerate(nodes[1:], 1):
            where = {"": 1, " ": above[n.parent], ">": nodes[n.parent].steps, "+": last[n.parent], "~": earlier[n.parent]}
            for b, s in enumerate(self.steps):
                if (not s.before or where[s.how] & s.before) and all(test(tree, i) for test in s.tests):
                    n.steps |= 1 << b
            above[i] = above[n.parent] | n.steps
            last[n.parent] = n.steps
            earlier[n.parent] |= n.steps


def _nth(arg: str, selector: str) -> Callable[[int], bool]:
    m = re.fullmatch(r"(?P<word>odd|even)|(?:(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?)|(?P<n>[+-]?\d+)", (arg or "").lower())
    if not m:
        raise SelectorError(f"invalid selector {selector!r}: {arg!r} is no place")
    if m["word"]:
        a, b = 2, int(m["word"] == "odd")
    elif m["n"]:
        a, b = 0, int(m["n"])
    else:
        a, b = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"]), int((m["sign"] or "+") + (m["b"] or "0"))
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _pseudo(what: str, arg: str | None, selector: str) -> Test:
    places: dict[str, Callable[[Node], int]] = {
        "nth-child": lambda n: n.place, "nth-last-child": lambda n: n.siblings - n.place + 1,
        "nth-of-type": lambda n: n.of_type, "nth-last-of-type": lambda n: n.same_type - n.of_type + 1,
    }
    first = {"first-child": "nth-child", "last-child": "nth-last-child", "first-of-type": "nth-of-type", "last-of-type": "nth-last-of-type"}
    if what in places:
        place, ok = places[what], _nth(arg, selector)
        return lambda t, i: ok(place(t.nodes[i]))
    if what in first:
        place = places[first[what]]
        return lambda t, i: place(t.nodes[i]) == 1
    if what == "only-child":
        return lambda t, i: t.nodes[i].siblings == 1
    if what == "empty":
        return lambda t, i: t.nodes[i].end == i + 1 and i not in t.filled
    if what in ("not", "is", "where") and arg:
        inner = Selectors()
        inner.add(arg)
        if any(s.before for s in inner.steps):
            raise SelectorError(f"invalid selector {selector!r}: :{what}() takes tests of one element")
        holds = lambda t, i: any(all(test(t, i) for test in s.tests) for s in inner.steps)
        return (lambda t, i: not holds(t, i)) if what == "not" else holds
    raise SelectorError(f"invalid selector {selector!r}: :{what} is not known")


# Operators ----------------------------------------------------------------------------------------------------------


def _walk(df: DataFrame, schema: str, rows: Callable[[str, str], list[tuple]]) -> DataFrame:
    """rows(url, html) of each page, in Arrow batches; nothing is shuffled."""
    names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(parts):
        for part in parts:
            for lo in range(0, len(part), 256):
                piece = part.iloc[lo : lo + 256]
                yield pd.DataFrame([r for u, h in zip(piece["url"], piece["html"], strict=True) for r in rows(u or "", h or "")], columns=names)

    return df.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, schema)


def elements(df: DataFrame, selector: str) -> DataFrame:
    """url, n (from 0), tag, text, attrs, link of each element that the selector finds, in the order of the page; link is the address of its href.
    A null page has none. Elements that a page repeats each have a row."""
    table = Selectors()
    ends = table.add(selector)

    def rows(url: str, html: str) -> list[tuple]:
        tree = Tree(html)
        table.match(tree)
        found = [i for i, n in enumerate(tree.nodes) if n.steps & ends]
        return [(url, k, tree.nodes[i].tag, tree.text(i), tree.nodes[i].attrs, tree.value(i, "href", url)) for k, i in enumerate(found)]

    return _walk(df, "url string, n int, tag string, text string, attrs map<string,string>, link string", rows)


def records(df: DataFrame, fields: dict[str, str], each: str | None = None) -> DataFrame:
    """url, n and a column for each field NAME: "CSS", the text of the first element found, or "CSS@attribute"; @attribute alone is one of the
    record's own element. With `each`, a record for each element that it finds, whose fields are looked for inside it; without, one for the page. A
    record without any value is left out."""
    table = Selectors()
    outer = table.add(each) if each else 0
    parts = {name: re.fullmatch(r"(.*?)(?:@([\w:-]+))?", css.strip(), re.S).groups() for name, css in fields.items()}
    inner = {name: table.add(css) if css.strip() else 0 for name, (css, _) in parts.items()}

    def rows(url: str, html: str) -> list[tuple]:
        tree = Tree(html)
        table.match(tree)
        heads = [i for i, n in enumerate(tree.nodes) if n.steps & outer] if each else [0]
        out = []
        for k, at in enumerate(heads):
            got = []
            for name, bits in inner.items():
                own = next((i for i in range(at + 1, tree.nodes[at].end) if tree.nodes[i].steps & bits), None) if bits else at
                got.append(None if own is None else tree.value(own, parts[name][1], url))
            if any(x is not None for x in got):
                out.append((url, k, *got))
        return out

    return _walk(df, ", ".join(["url string", "n int", *[f"c{i} string" for i in range(len(fields))]]), rows).toDF("url", "n", *fields)


def next_pages(df: DataFrame, selector: str) -> DataFrame:
    """url, next: the address of the first element found, if it leads to another page."""
    out = records(df, {"next": f"{selector}@href"}).select("url", "next")
    return out.filter((F.col("next") != F.col("url")) & F.col("next").rlike("^https?://"))


def matched(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """url and, for each selector, how many elements it finds; all in one walk of each page."""
    table = Selectors()
    ends = {name: table.add(css) for name, css in wanted.items()}

    def rows(url: str, html: str) -> list[tuple]:
        tree = Tree(html)
        table.match(tree)
        return [(url, *[sum(bool(n.steps & bits) for n in tree.nodes) for bits in ends.values()])]

    return _walk(df, ", ".join(["url string", *[f"c{i} int" for i in range(len(wanted))]]), rows).toDF("url", *wanted)
