"""Hashes by which words within one or two edits meet."""

import numpy as np

from eventloom.operators import search


def left(w, most):
    one = {w[:i] + w[i + 1 :] for i in range(len(w))}
    return {w} | one | ({x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if most == 2 else set())


def test_keys_are_those_of_what_is_left():
    words = ["market", "makret", "marketing", "aaaa", "abcab", "naïveté", "markets"]
    for most in (1, 2):
        at, keys = search._keys(words, most)
        for i, w in enumerate(words):
            assert set(keys[at == i].tolist()) == {int(search._keys([x], 1)[1][0]) for x in left(w, most)}, w
    assert len(search._keys([], 2)[0]) == 0


def test_only_words_whose_keys_may_be_asked_for_are_shuffled(spark):
    vocab = spark.createDataFrame([("market", 9), ("unrelated", 5), ("elsewhere", 7), ("bridge", 3)], "word string, n long")
    asked = search._keyed(spark.createDataFrame([("makret", 1)], "w string, most int"), "most int")
    table = search._table(asked)
    rows = vocab.selectExpr("word as w", "n", "2 as most")
    kept = search._keyed(rows, "n long", table).collect()
    assert {r.w for r in kept} == {"market"} and len(kept) < search._keyed(rows, "n long").count() / 10
    assert np.bitwise_count(table.value).sum() == len({r.key for r in asked.collect()})
