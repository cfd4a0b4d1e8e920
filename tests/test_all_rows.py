"""Queries over all rows against plain Python."""

import collections
import datetime
import hashlib
import math
import re

import pytest

from eventloom import queries as Q
from eventloom.operators import core
from eventloom.operators.search import edits

HEAD = "Über Straßen"
TEXTS = [f"{HEAD} of 2024: it's naïve?\nBridges and rivers and bridges", f"{HEAD} of 2024: it's naïve?\nBridges and rivers and castles", "Plain title only", "plain  TITLE only", "ÉCLAIR don't 12 12b", None, "", "x" * 100 + " " + "filler words " * 40 + "zanzibar", "Plain title only"] + [f"Wonder wondering crème {i}" for i in range(25)]
ROWS = [(i + 1, t, "en", f"src{i % 2}", 0) for i, t in enumerate(TEXTS)]
TALKS = [(1, 0, "user", "Don't stop, 2 lamps!"), (1, 1, "bot", "lamps?\nat https://e.org/x Ünder lamps"), (2, 0, "user", None), (2, 1, "bot", "plain lamps")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("all")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(TALKS, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def stem(w):
    if re.search("(ss|us|is|ws)$", w):
        return w
    for end, least, cut in (("y", 5, 1), ("ies", 7, 3), ("ing", 7, 3), ("ed", 6, 2), ("es", 5, 1), ("s", 4, 1)):
        if w.endswith(end) and len(w) >= least:
            return w[: -2 if end == "es" and re.search("(s|x|z|ch|sh)$", w[:-2]) else -cut]
    return w


def items():
    """doc_id, feed, key, month, and the text that keys, words and postings come from."""
    for i, t, _, feed, _ in ROWS:
        title, whole = parts(t)
        date = datetime.date(2023, 1, 1) + datetime.timedelta(i * 37 % 800)
        key = None
        if title is not None:
            folded = re.sub(r"\s+", " ", title.replace("ß", "ss").lower()).strip(" ")
            key = hashlib.sha256(f"{feed}\nhttps://e.org/{i % 700}\n{folded}".encode()).hexdigest()[:16]
        yield i, feed, key, str(date)[:7], title or "", whole


def parts(t):
    return t or "", t or ""


def test_keys_and_archive(spark, folder):
    got = {r.doc_id: r.key for r in Q.item_key_hash(spark, folder).collect()}
    assert got == {i: k for i, _, k, *_ in items()}
    archive = {(r.month, r.key, r.doc_id) for r in Q.archive_upsert(spark, folder).collect()}
    assert {i for *_, i in archive} >= {i for i, _, k, *_ in items() if k}
    copies = collections.Counter((m, k) for _, _, k, m, *_ in items())
    assert {(r.month, r.key): r.copies for r in Q.validate_duplicates(spark, folder).collect()} == {x: n for x, n in copies.items() if n > 1}


def test_postings(spark, folder):
    want = collections.defaultdict(set)
    for _, feed, _, month, title, _ in items():
        for w in re.findall(r"[\w']+", title.lower()):
            if len(w) > 2 and not re.fullmatch(r"[0-9]+", w):
                want[stem(w), feed].add(month)
    assert {(r.word, r.feed): r.months for r in Q.word_postings(spark, folder).collect()} == {k: " ".join(sorted(v)) for k, v in want.items()}
    months = collections.defaultdict(set)
    for (w, _), m in want.items():
        months[w] |= m
    assert {r.word: (r.shard, r.n) for r in Q.word_postings_rare(spark, folder).collect()} == {w: (w[:2], len(m)) for w, m in months.items()}
    assert {"naïve", "éclair", "don't", "12b", "zanzibar"} <= set(months)


def test_vocabulary_and_repair(spark, folder):
    v = collections.Counter(w for *_, whole in items() for w in re.findall(r"\b[a-z]{4,}\b", whole.lower(), re.A))
    asked = {w[:2] + w[3] + w[2] + w[4:] for w, n in v.items() if len(w) >= 6 and n >= 20} - set(v)
    want = {}
    for w in asked:
        near = [(n, x) for x, n in v.items() if edits(w, x, 2 if len(w) >= 9 else 1) <= (2 if len(w) >= 9 else 1)]
        if near:
            want[w] = max(near)[1]
    assert want and {r.word: r.fixed for r in Q.typo_vocab(spark, folder).collect()} == want


def test_search_and_rank(spark, tmp_path):
    far = "first line\n" + "filler " * 90
    texts = [far + "that with", "that with\n" + far, far + "that", None, "with", far + "the", "Ünder that\nwith"]
    rows = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in Q.search_all_words(spark, str(tmp_path)).collect()} == {0, 1, 6}
    assert {r.doc_id for r in Q.search_feed_filter(spark, str(tmp_path)).collect()} == {5}
    n, d = len(rows), {w: sum(w in (t or "").split() for t in texts) for w in ("that", "with")}
    rarity = {w: 1 + math.log((n + 1) / (1 + c)) for w, c in d.items()}
    weight = {0: (1, 1), 1: (2, 2), 6: (2, 1)}
    want = {i: round(a * rarity["that"] + b * rarity["with"], 6) for i, (a, b) in weight.items()}
    got = Q.rank_tfidf(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: s for i, s in want.items() if s >= max(want.values()) / 2}) and {r.coverage for r in got} == {2}


def test_words_of_all_turns(spark, folder):
    got = {r.word: r.n for r in Q.extract_words_count(spark, folder).collect()}
    assert got["lamps"] == 3 and got["stop"] == 1 and not {"https", "org"} & set(got) and not set(core.STOPWORDS) & set(got)
