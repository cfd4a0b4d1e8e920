"""Thai terms against a search of all ways to read a run, and in searches."""

import random
import re

import pytest

from eventloom.functions import thai
from eventloom.operators import search


def plain(run):
    """All pieces of a run, letter by letter."""

    def read(rest, held):
        if not rest:
            return [held]
        word = max((w for w in [*thai.NEWS, *thai.SHAPING] if rest.startswith(w) and not (held and len(w) <= thai.SHORT)), key=len, default="")
        return [held, word, *read(rest[len(word) :], "")] if word else read(rest[1:], held + rest[0])

    return [t for t in read(run, "") if t not in thai.SHAPING and (t in thai.NEWS or len(t) >= 2)]


def test_terms(spark):
    r = random.Random(4)
    words = [*thai.NEWS, *thai.SHAPING]
    texts = ["".join(r.choice([r.choice(words), r.choice(words)[: r.randint(1, 4)], "ก", "สม", " ", "a", "ๆ"]) for _ in range(r.randint(0, 8))) for _ in range(400)] + ["ราคาทองวันนี้", "พื้นที่น้ำท่วม", None, "", "abc"]

    want = [[t for run in re.findall(thai.RUN, x or "") for t in plain(run)] for x in texts]
    assert [thai.terms_of(x) for x in texts] == want and want[400:402] == [["ราคา", "ทอง"], ["พื้นที่", "น้ำท่วม"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    assert {x.i: x.terms for x in df.select("i", thai.terms(df.t).alias("terms")).collect()} == dict(enumerate(want))


@pytest.mark.parametrize(("word", "found"), [("น้ำท่วม", {1, 2, 3}), ("ทองคำ", {4, 5}), ("สมชาย", {6}), ("สหรัฐ", {7, 8})])
def test_search_finds_thai_words(spark, word, found):
    texts = {1: "ข่าวน้ำท่วมกรุงเทพ", 2: "ท่วม", 3: "Floods in the north", 4: "ราคาทองวันนี้", 5: "Gold price", 6: "นายสมชายกล่าว", 7: "The US said", 8: "อเมริกา", 9: "bus"}
    df = spark.createDataFrame([(i, t, None, "news", "2024-01-01") for i, t in texts.items()], "key int, title string, summary string, feed string, date string")
    assert {x.key for x in search.find(df, [word]).collect()} == found
