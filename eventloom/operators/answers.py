"""Questions: their words, how far back they look, the period they name, and answers from ranked items. All of it works on the
question and at most a screen of items, on the driver."""

from __future__ import annotations

import itertools
import math
import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search
from .core import STOPWORDS

#: Words that make a question, but not its subject.
ASKING = frozenset(
    """what which who whom whose when where why how many much any anything something happened happening new newest latest recent
    recently tell show list find give news week today yesterday month year last past ago day days weeks months years biggest largest
    highest strongest most least lowest smallest deadliest ever big""".split()
)
#: Which end of the sizes a word asks for.
ENDS = {"most": "most biggest largest highest strongest top deadliest worst", "least": "least smallest lowest weakest fewest", "notable": "big major huge"}
MONTHS = "january february march april may june july august september october november december".split()
#: How many days back a word reaches that names a time.
SPANS = {r"today": 2, r"yesterday": 3, r"(?:this|last|past) week|lately|recent(?:ly)?": 8, r"(?:this|last|past) month": 32, r"(?:this|last|past) year": 367}
#: Words whose full stop ends no sentence.
SHORTENED = frozenset("st mr mrs ms dr inc corp co ltd no vs jr sr".split())


def terms(question: str) -> list[str]:
    """The different words that are worth searching for, in order."""
    split = (w.strip("'-_") for w in re.split(r"[^\w'-]+", question.lower()))
    known = ASKING.union(STOPWORDS)
    return list(dict.fromkeys(w for w in split if len(w) > 1 and w not in known))


def days(question: str) -> int | None:
    """The widest span that the question names."""
    named = [n for p, n in SPANS.items() if re.search(rf"\b(?:{p})\b", question.lower())]
    return max(named) if named else None


def needed(words: list[str]) -> int:
    """How many words an item must have: all of two, three fifths of more."""
    return max(min(len(words), 2), math.ceil(0.6 * len(words)))


def superlative(question: str) -> str | None:
    """most or least by the first word that asks for an end; else notable, if any word does."""
    asked = [kind for w in re.split(r"\W+", question.lower()) for kind, some in ENDS.items() if w in some.split()]
    ends = [k for k in asked if k != "notable"]
    return (ends or asked or [None])[0]


def period(text: str, today: date) -> tuple[str, str] | None:
    """First and last month that a question names: a year, a month of a year, last or this year, or ever."""
    t = text.lower()
    if re.search(r"\bever\b|\ball[- ]time\b", t):
        return "1800-01", today.isoformat()[:7]
    if m := re.search(r"\b(last|this) year\b", t):
        y = today.year - (m[1] == "last")
        return f"{y}-01", f"{y}-12"
    if m := re.search(r"\b((?:19|20)\d\d)-(0[1-9]|1[0-2])\b", t):
        return (m[0], m[0]) if int(m[1]) <= today.year else None
    names = "|".join(f"{n}|{n[:3]}" for n in MONTHS)
    if m := re.search(rf"\b(?:({names})\.?\s+)?((?:19|20)\d\d)\b", t):
        if int(m[2]) > today.year:
            return None
        if m[1]:
            month = f"{m[2]}-{[n[:3] for n in MONTHS].index(m[1][:3]) + 1:02d}"
            return month, month
        return f"{m[2]}-01", f"{m[2]}-12"
    return None


def candidates(items: DataFrame, question: str, today: date, limit: int = 8, tie: str = "key") -> DataFrame:
    """The best items for a question: its period or span first, then by rank, or by size if it asks for the most or least."""
    if p := period(question, today):
        items = items.filter(F.substring("date", 1, 7).between(*p))
    elif n := days(question):
        items = items.filter(F.col("date") >= F.date_format(F.date_sub(F.lit(today), n), "yyyy-MM-dd"))
    words = terms(question)
    kind = superlative(question)
    if kind in ("most", "least"):
        return search.biggest(search.find(items, words) if words else items, kind == "least", limit, tie)
    ranked = search.rank(items, words, limit, tie=tie)
    return ranked.filter(F.col("coverage") >= needed(words))


def picked(reply: str, count: int, most: int = 5) -> list[int] | None:
    """The items that a deciding model names: a word, `use` with numbers behind it or `none`. None if it says neither."""
    word, *rest = re.findall(r"[a-z]+|\d+", reply.lower()) or [""]
    if word == "none":
        return []
    numbers = list(itertools.takewhile(str.isdigit, rest))
    if word != "use" or not numbers:
        return None
    return list(dict.fromkeys(n for n in map(int, numbers) if 0 < n <= count))[:most]


def sentence(text: str, words: int = 30) -> str:
    """The first sentence, cut after so many words. A shortened word, or a single capital as in a name, does not end it."""
    out = []
    for w in (text or "").split():
        out.append(w)
        bare = w[:-1].lstrip("(\"'")
        if w[-1] in "!?" or w[-1] == "." and bare.lower() not in SHORTENED and not (len(bare) == 1 and bare.isupper()):
            break
    return " ".join(out[:words]) + "…" * (len(out) > words)


#: What an answer says, by how many items it rests on.
SAYINGS = {
    "empty": "No source has anything on this.",
    "unsure": "None of the sources settles this; nearest to it: {first} [1]",
    "one": "{title}{when} [{n}]{more}",
    "many": "{count} sources: {list}",
}


def written(rows: list[dict], choice: list[int]) -> str:
    """An answer from the chosen rows only, each cited by its number."""
    if not rows or not choice:
        return SAYINGS["unsure" if rows else "empty"].format(first=rows[0]["title"] if rows else "")
    if choice[1:]:
        return SAYINGS["many"].format(count=len(choice), list="; ".join(f"{' '.join(rows[n - 1]['title'].split()[:10])} [{n}]" for n in choice))
    row, n = rows[choice[0] - 1], choice[0]
    day, first = (row.get("date") or "")[:10], sentence(row.get("summary") or "")
    when = f", {day}" if day and day not in row["title"] else ""
    more = f" {first} [{n}]" if first and first not in row["title"] else ""
    return SAYINGS["one"].format(title=row["title"].rstrip("."), when=when, n=n, more=more)


def answer(items: DataFrame, question: str, today: date, decide=None, tie: str = "key") -> str:
    """decide: a function of (question, rows) that replies as a model would; without one, the best matches are listed."""
    rows = [r.asDict() for r in candidates(items, question, today, tie=tie).collect()]  # at most a screen
    choice = picked(decide(question, rows), len(rows)) if decide and rows else None
    return written(rows, list(range(1, min(3, len(rows)) + 1)) if choice is None else choice)
