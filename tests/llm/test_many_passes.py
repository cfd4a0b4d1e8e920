"""Items in many passes, and document statistics against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from eventloom.llm import decontam, linededup, quality, textkit as tk


def test_clean_in_many_passes(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(20)] + [(None, None), (30, "")]
    docs = [(i, " ".join([*(word() for _ in range(40)), items[i % 20][1] if i % 3 == 0 else "", *(word() for _ in range(40))])) for i in range(60)] + [(100, None), (100, ""), (None, items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in df.collect())
    whole, leaks = key(decontam.clean(d, b)), sorted(map(str, decontam.leaks(d, b).collect()))
    assert len(whole) == 60 - 20 + 2
    monkeypatch.setattr(decontam, "ITEMS", 2)
    assert len(list(decontam._passes(b, "item_id", "text"))) > 8
    assert key(decontam.clean(d, b)) == whole and sorted(map(str, decontam.leaks(d, b).collect())) == leaks


def plain(t):
    raw, words, lines = t.encode(), re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n") if t else []
    if lines and lines[-1] == "":
        lines.pop()
    share = lambda k, n: k / max(n, 1)
    letters = sum(chr(x).isalpha() for x in raw if x < 128)
    counts = Counter(raw)
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_bytes": share(sum(len(w.encode()) for w in words), len(words)),
        "upper": share(sum(65 <= x <= 90 for x in raw), letters), "lower": share(letters, len(raw)), "digit": share(sum(48 <= x <= 57 for x in raw), len(raw)),
        "non_ascii": share(sum(x > 127 for x in raw), len(raw)), "byte_entropy": -sum(c / len(raw) * math.log(c / len(raw)) for c in counts.values()), "mark_35": share(counts[35], len(raw)),
        "lines": math.log1p(len(lines)), "line_words": share(len(words), len(lines)), "distinct_words": share(len(set(words)), len(words)),
        "top_word": share(max(Counter(words).values(), default=0), len(words)), "same_as_before": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "short_words": share(sum(len(w.encode()) <= 2 for w in words), len(words)), "long_words": share(sum(len(w.encode()) > 20 for w in words), len(words)),
        "capitalised": share(sum("A" <= w[0] <= "Z" for w in words), len(words)),
    }


def test_statistics_against_plain_python():
    r = random.Random(9)
    texts = ["", "One two.\nOne two.\n\nX", "É!! é # ## a a a", "\n", "x" * 50 + "\n"] + ["".join(r.choice(["ab", "Cd", " ", "\n", "é", "#", "9", ".", "日本", "longlonglonglonglonglong"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    got = quality.statistics(*tk.flat(pa.array(texts, pa.string())))
    for row, t in zip(got, texts):
        for name, v in plain(t).items():
            assert np.isclose(row[quality.NAMES.index(name)], v, atol=1e-5), (name, t)


def test_a_leaf_with_more_templates_than_three(spark):
    """Five templates of one leaf: the lines of each go, save the first of its template."""
    family = lambda f, i: f"in this place {' '.join(f'{c}{chr(97 + f)}' for c in 'klmnop')} host-{'abcdefghij'[i]}"
    rows = [(100 * f + i, f"{family(f, i)}\nshort one") for f in range(5) for i in range(10 - f)]
    got = {r.doc_id: r.n_dropped for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(d % 100 > 0) for d, _ in rows}
