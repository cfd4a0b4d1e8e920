"""Filter audit, ranked lexical search and quality rules against plain Python."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import filteraudit, lexical, rules, textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB é.\t\n '#1ßİ́日,|s"), max_size=60), st.lists(st.sampled_from(["ab", "c", "D|", "é", "\n", "\n\n", "#"]), max_size=60).map(" ".join)), max_size=8)
CLASH = ["row", "bucket", "term", "part", "A", "E", "first", "h1", "n", "good", "kept", "score", "rank", "filters"]


def table(spark, rows):
    """rows (id, text, source) with columns whose names the operators use."""
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema).repartition(3)


# Filter audit -------------------------------------------------------------------------------------------------------


def plain_fails(i, text, rows):
    t = text or ""
    w = WORD.findall(t)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]


def plain_audit(rows, labels):
    marks = [(p or "", plain_fails(i, t, rows), any(a == i and i is not None and q == 1 for a, q, _ in labels), any(a == i and i is not None and x == 1 for a, _, x in labels)) for i, t, p in rows]
    out = {}
    for part in {m[0] for m in marks}:
        own = [m for m in marks if m[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                shapley[f] += len(gone)
                key = (part, "".join("ABCDE"[x] for x in order), step + 1)
                out[key] = [len(left), len(gone), sum(m[1][f] for m in own) - len(gone), sum(m[1] == [x == f for x in range(5)] for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley["ABCDE".index(key[1][key[2] - 1])])
    return out


@pytest.fixture(scope="module")
def audited():
    r = random.Random(3)
    word = lambda: r.choice(["ab", "Cd", "é", "x" * r.randint(1, 9), "e|", "日本"])
    texts = [" ".join(word() if r.random() < 0.4 else f"w{r.randint(0, 10**6)}" for _ in range(r.choice([3, 150, 199, 200, 260]))) for _ in range(40)]
    rows = [(i, r.choice(texts), r.choice(["a", "b", "", None])) for i in range(120)]
    rows += [(None, texts[0], "a"), (3, texts[1], "b"), (3, texts[1], "b"), (500, None, "c"), (501, "", "c"), (502, None, "c"), (None, None, None), (503, "q " * 50_000, "d")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 120, 2)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (7, None, None), (10**6, 1, 1)]
    return rows, labels


def as_keyed(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_against_each_order(spark, audited):
    rows, labels = audited
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks = filteraudit.standard_marks(table(spark, rows), lab)
    want = plain_audit(rows, labels)
    assert as_keyed(filteraudit.audit(marks, list("ABCDE"), ["good", "toxic"])) == want and len(want) == 600 * 5
    assert filteraudit.audit(filteraudit.standard_marks(table(spark, rows).limit(0), lab), list("ABCDE"), ["good", "toxic"]).count() == 0
    none = as_keyed(filteraudit.audit(filteraudit.standard_marks(table(spark, rows), lab.limit(0)), list("ABCDE"), ["good", "toxic"]))
    assert {k: v[:4] for k, v in none.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in none.values())


def test_copies_by_shuffle_as_by_broadcast(spark, audited):
    marks = filteraudit.own_marks(table(spark, audited[0]))
    key = lambda df: collections.Counter((r.doc_id, r.part, r.A, r.E) for r in df.collect())
    assert key(filteraudit.with_copies(marks)) == key(filteraudit.with_copies(marks, heavy=30, most=0)) == key(filteraudit.with_copies(marks, heavy=1, most=0))


def test_audit_of_own_marks(spark):
    """Fewer filters with names of their own, no labels, null marks and parts, and more parts than a task holds."""
    rows = [(f"p{i % 50}" if i % 7 else None, i % 3 == 0, None if i % 5 == 0 else i % 2 == 0) for i in range(400)]
    kept, filteraudit.PARTS = filteraudit.PARTS, 8
    try:
        got = {(r["part"], r["filter_order"], r["step"]): r for r in filteraudit.audit(spark.createDataFrame(rows, "part string, old boolean, odd boolean"), ["old", "odd"], []).collect()}
    finally:
        filteraudit.PARTS = kept
    for part in {p or "" for p, _, _ in rows}:
        own = [(a, bool(b)) for p, a, b in rows if (p or "") == part]
        assert got[part, "oldodd", 2]["removed"] == sum(b and not a for a, b in own) and got[part, "oddold", 1]["kept"] == sum(not b for _, b in own)
    with pytest.raises(ValueError, match="six"):
        filteraudit.audit(spark.range(1), list("abcdefg"), [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.booleans(), min_size=4, max_size=4)), min_size=1, max_size=300))
def test_bitmaps(rows):
    part, flags = np.array([p for p, _ in rows]), np.array([f for _, f in rows])
    ids, part = np.unique(part, return_inverse=True)
    got = filteraudit.survivors(part, len(ids), [flags[:, 0], flags[:, 1], flags[:, 2]], [flags[:, 3]])
    for p in range(len(ids)):
        for s in range(8):
            stay = (part == p) & ~flags[:, [i for i in range(3) if s >> i & 1]].any(1)
            assert got[p, s].tolist() == [stay.sum(), (stay & flags[:, 3]).sum()]


# Lexical search -----------------------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    split = [(i, collections.Counter(terms(t))) for i, t, _ in docs]
    n_docs, total = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = collections.Counter(t for _, c in split for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc, c in split:
            m = 50 + 50 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_search_against_plain_loops(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(30)] + ["é", "日本", "İx", "naïve", "42", "the"]
    text = lambda n: "".join(r.choice(vocab[: 1 + int(len(vocab) * r.random() ** 2)]) + r.choice([" ", "_", "-", "\n", "\x00", ". ", "|"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60)), "s") for i in range(150)]
    docs += [(151, docs[0][1], "s"), (151, docs[0][1], "s"), (None, docs[0][1], "s"), (152, None, "s"), (153, "", "s"), (154, "...", "s"), (155, "THE the The " * 5000, "s")]
    items = [(i, text(r.randint(1, 12))) for i in range(12)] + [(3, "w1 W2"), (None, "naïve the"), (20, None), (21, "!!"), (22, "unseen")]
    it = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, term string")
    for k, pairs in ((50, lexical.PAIRS), (3, 20)):
        got = sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in lexical.search(table(spark, docs), it, k=k, pairs=pairs).collect()], key=str)
        assert got == plain_search(docs, items, k)
    assert lexical.search(table(spark, docs).limit(0), it).count() == 0 and lexical.search(table(spark, docs), it.limit(0)).count() == 0


def test_search_shuffles_postings_not_matches(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('the w', id % 50) as text")
    plan = lexical.search(docs, docs.selectExpr("doc_id as item_id", "text").limit(20))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" in plan and "hashpartitioning(item_id#" in plan and "hashpartitioning(item_id, row" not in re.sub(r"#\d+L?", "", plan)


# Quality rules ------------------------------------------------------------------------------------------------------


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_rule_counts(texts):
    got = [x.tolist() for x in rules.base(*tk.flat(pa.array(texts, pa.string())))]
    assert list(map(list, zip(*got))) == [plain_counts(t) for t in texts]


def plain_verdict(t):
    """Limits between two lengths go by the logarithm, written out."""
    pack = zstandard.ZstdCompressor(level=rules.LEVEL, write_checksum=False, write_content_size=False).compress
    b = (t or "").encode()

    def side(x):
        i = max(j for j, row in enumerate(rules.BANDS) if row[0] <= len(x))
        lo, hi = rules.BANDS[i], rules.BANDS[min(i + 1, len(rules.BANDS) - 1)]
        share = 0 if lo == hi else (math.log2(len(x)) - math.log2(lo[0])) / (math.log2(hi[0]) - math.log2(lo[0]))
        r = 1000 * len(pack(x)) / len(x)
        return -1 if r < lo[1] + share * (hi[1] - lo[1]) else 1 if r > lo[2] + share * (hi[2] - lo[2]) else 0

    if not b:
        return True
    chunks = [b[i : i + rules.CHUNK] for i in range(0, len(b), rules.CHUNK)]
    if len(chunks) > 1 and len(chunks[-1]) < rules.SHORT:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    return side(b) == 0 and 100 * sum(len(c) for c in chunks if side(c)) <= rules.ODD_PERCENT * len(b)


def prose(r, n):
    """Made-up words of many syllables: about as compressible as prose."""
    syllable = lambda: r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t", "l"])
    known = ["".join(syllable() for _ in range(r.randint(1, 3))) for _ in range(4000)]
    return " ".join(r.choice(known[: r.choice([60, 600, 4000])]) for _ in range(n))


def test_rules_on_texts(spark):
    r = random.Random(11)
    noise = lambda n: " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9)) for _ in range(n))
    good = [prose(r, n) for n in (60, 200, 1500, 12000)]
    mixed = prose(r, 3000) + " " + "again and again we say the same of it " * 300 + prose(r, 800)
    bad = {"noise": noise(400), "list": " ".join(f"{w} {w}" for w in ["spam", "eggs"] * 400), "mixed": mixed, "long": "word " * 400_000}
    rows = [(i, t, "s") for i, t in enumerate([*good, *bad.values(), None, "", "\n \n", "few words"])] + [(None, good[0], "s"), (0, good[0], "s")]
    got = rules.judge(table(spark, rows)).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for i, t, _ in rows:
        for x in by[i]:
            counts = plain_counts(t)
            assert [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed] == counts
            assert x.kept == (not counts[-1] and plain_verdict(t)) and x.n_bytes == len((t or "").encode())
    assert all(by[i][0].kept for i in range(4)) and not any(by[i][0].kept for i in range(4, 12))
    assert by[4][0].reason == "incompressible" and by[5][0].reason == "repetitive" and not by[4][0].base_failed and by[8][0].base_failed and len(by[0]) == 2
    docs = table(spark, rows)
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["0", "0", "1", "2", "3", "None"]
    assert rules.judge(docs.limit(0)).count() == 0
