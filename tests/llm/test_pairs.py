"""Near duplicates, repeated strings, lines and benchmark passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from test_text import words

from eventloom.llm import decontam, jaccard, linededup, substrings, textkit as tk


def sets_of(r, n, universe=400):
    base = [np.array(sorted(r.sample(range(universe), r.randint(1, 60))), np.uint64) for _ in range(6)]
    out = []
    for _ in range(n):
        x = set(r.choice(base).tolist())
        for _ in range(r.randint(0, 4)):
            x ^= {r.randrange(universe)}
        if x:
            out.append(tuple(sorted(x)))
    return [np.array(x, np.uint64) for x in dict.fromkeys(out)]


def linked(a, b, percent):
    both = len(set(a.tolist()) & set(b.tolist()))
    return 100 * both >= percent * (len(a) + len(b) - both)


def groups(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_join_loses_no_link(percent):
    for seed in range(60):
        r = random.Random(seed)
        sets = sorted(sets_of(r, 40), key=len)
        links = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], percent)]
        assert groups(len(sets), jaccard.join(sets, percent)) == groups(len(sets), links)


def test_join_documents(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randint(2, 120))] for _ in range(25)]
    rows, n = [], 0
    for b in base:
        for _ in range(r.randint(1, 5)):
            x = list(b)
            for _ in range(r.randint(0, 2)):
                x[r.randrange(len(x))] = f"v{r.randrange(9)}"
            rows.append((n, " ".join(x).upper() if r.random() < 0.2 else " ".join(x)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a"), (n + 4, "A"), (n + 4, "A")]
    r.shuffle(rows)
    for k, percent, hot in ((3, 90, 200_000), (5, 80, 200_000), (1, 60, 200_000), (1, 80, 1)):
        sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for i, t in rows}
        label = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = label[a], label[b]
                    label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
        df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, node string").repartition(3)
        got = jaccard.join_documents(df, words=k, percent=percent, weight=300, hot=hot).collect()
        assert len(got) == len(rows)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (len(sets[i]), label[i]) for i in sets}
    assert jaccard.join_documents(df.limit(0)).count() == 0


def test_construction_finds_repeated_windows():
    for seed in range(150):
        r = random.Random(seed)
        size = r.choice([3, 5, 8])
        base = [bytes(r.choice(b"ab\xc3\xa9 c") for _ in range(r.randint(0, 40))) for _ in range(6)]
        texts = [b"".join(r.choice(base)[r.randint(0, 10) :] for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 12))]
        c = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        assert [x.tolist() for x in substrings.repeated(texts, size)] == [[c[t[i : i + size]] > 1 for i in range(len(t) - size + 1)] for t in texts]


def removed(rows, size):
    c = collections.Counter(b[i : i + size] for _, b in rows for i in range(len(b) - size + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if c[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return collections.Counter(out)


def test_remove(spark, monkeypatch):
    r = random.Random(2)
    part = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared = [part(90) for _ in range(4)]
    rows = [(i, part(r.randint(0, 80)) + r.choice(shared)[r.randint(0, 30) :] * r.randint(0, 2) + part(r.randint(0, 60))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, shared[0]), (None, part(200)), (7, rows[7][1]), (102, "ab" * 300), (103, part(3000) + shared[1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, th int").repartition(3)
    want = removed([(i, (t or "").encode()) for i, t in rows], 40)
    assert collections.Counter(tuple(x) for x in substrings.remove(df, size=40).collect()) == want
    monkeypatch.setattr(substrings, "CROWD", 3)
    assert collections.Counter(tuple(x) for x in substrings.remove(df, size=40).collect()) == want
    kept = {x.doc_id: bytes(x.kept) for x in substrings.remove(df, size=40, with_text=True).collect()}
    assert kept[101] == b"" and 0 < len(kept[103]) < len(rows[-1][1].encode())
    assert substrings.remove(df.limit(0), size=40).count() == 0


def test_shared_stretches_hold_all_that_two_regions_share():
    for seed in range(100):
        r = random.Random(seed)
        base = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(3)]
        group = [(r.choice(base)[r.randint(0, 12) :] + b"KEY" + r.choice(base)[: r.randint(0, 12)]) for _ in range(r.randint(2, 7))]
        group = [(g, g.index(b"KEY")) for g in dict.fromkeys(group)]
        if len(group) < 2:
            continue
        for (a, k), (lo, hi) in zip(group, substrings.shared(group)):
            for b, m in group:
                if b != a:
                    right = next((i for i in range(min(len(a) - k, len(b) - m)) if a[k + i] != b[m + i]), min(len(a) - k, len(b) - m))
                    left = next((i for i in range(min(k, m)) if a[k - 1 - i] != b[m - 1 - i]), min(k, m))
                    assert lo <= k - left and hi >= k + right


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 500)
    data = np.frombuffer(bytes(random.Random(1).choice(b"abcd") for _ in range(2600)), np.uint8)
    row, at, many, *_ = substrings.regions(data, np.array([0, 100, 2600]), 60, 16)
    assert sorted((r, s) for r, a, n in zip(row.tolist(), at.tolist(), many.tolist()) for s in range(a, a + n)) == [(0, s) for s in range(41)] + [(1, s) for s in range(2441)]


def test_windows_within_the_radius_are_all_found():
    rng = np.random.default_rng(4)
    own = rng.integers(0, 1 << 63, (40, 2), dtype=np.int64).view(np.uint64)
    asked = own[rng.integers(0, 40, 400)].copy()
    for row in asked:
        for bit in rng.choice(128, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    q, o = decontam.Blocks(own, 31).within(asked)
    want = {(i, j) for i in range(400) for j in range(40) if int(np.bitwise_count(asked[i] ^ own[j]).sum()) <= 31}
    assert set(zip(q.tolist(), o.tolist())) == want


def test_leaks(spark):
    r = random.Random(9)
    text = lambda n: [f"t{r.randrange(5000)}" for _ in range(n)]
    items = [(i, text(r.choice([3, 20, 35, 60]))) for i in range(30)] + [(90, []), (91, None)]
    rows, want = [], {}
    for i in range(120):
        body = text(r.randint(0, 300))
        if i % 3 == 0:
            item, passage = r.choice(items[:30])
            own = list(passage)
            if i % 2 and len(own) > 30:
                own[0] = "changed"
            at = r.randint(0, len(body))
            body = body[:at] + [w.upper() for w in own] + body[at:]
            want[i] = item
        rows.append((i, "  ".join(body)))
    rows += [(500, None), (501, ""), (None, " ".join(items[1][1]))]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in items], "item_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert {x.doc_id: x.item_id for x in got if x.doc_id is not None} == want
    assert [x.item_id for x in got if x.doc_id is None] == [1]
    assert all(x.similarity >= 0.8 for x in got)
    assert {x.doc_id for x in decontam.clean(df, bench).collect()} == {i for i, _ in rows} - set(want) - {None}
    assert decontam.leaks(df, bench.limit(0)).count() == decontam.leaks(df.limit(0), bench).count() == 0


def test_similarity_counts_repeats():
    a, b = np.array([1, 1, 2], np.uint64), np.array([1, 2, 2], np.uint64)
    assert decontam.similarity(a, b) == 2 / 4


LINE = "the server was started by user {} at noon today"


def test_lines(spark):
    rows = [(i, f"own words of text {'abcdefgh'[i]} stay here\n" + LINE.format(f"host-{'abcdefgh'[i]}") + "\nAll rights reserved 20" + str(10 + i) + "\nshort one") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n"), (None, "All rights reserved 1999")]
    df = spark.createDataFrame([(*x, "c", "d") for x in rows], "doc_id long, text string, n_lines string, leaf string").repartition(3)
    got = {x.doc_id: x for x in linededup.dedup(df).collect()}
    assert got[None].text == "All rights reserved 1999"  # the first of its template stays
    assert got[0].text.split("\n") == [rows[0][1].split("\n")[0], rows[0][1].split("\n")[1], "short one"] or got[0].n_dropped == 1
    for i in range(1, 8):
        assert "rights reserved" not in got[i].text and "server" not in got[i].text and got[i].text.endswith("short one") and got[i].n_lines == 4
    assert (got[20].text, got[20].n_lines, got[21].text, got[22].text) == (None, 0, "", "\n")
    assert linededup.dedup(df.limit(0)).count() == 0


def test_line_dedup_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(1)
    lines = [" ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(r.randint(1, 9))) + r.choice(["", " 12", " v3", "."]) for _ in range(40)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"create or replace view documents as from read_parquet('{tmp_path}/d/*.parquet')")
    want = {r[0]: tuple(r) for r in duckdb.sql(linededup.ORACLE).fetchall()}
    got = {x.doc_id: (x.doc_id, x.text, x.n_lines, x.n_dropped) for x in linededup.dedup(df).collect()}
    assert got == want and any(x[3] for x in got.values())


def test_a_row_repeated_often_is_one_region(spark):
    """Repeated rows are covered by each other, at the cost of one."""
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(700))
    df = spark.range(10_000).selectExpr("1L doc_id", f"'{text}' text").unionByName(spark.createDataFrame([(2, "x" + text[100:650]), (3, text[:150])], "doc_id long, text string"))
    got = collections.Counter(map(tuple, substrings.remove(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()))
    assert got == {(1, 700, 700, 1): 10_000, (2, 551, 550, 1): 1, (3, 150, 0, 0): 1}


def test_leaks_against_a_plain_search(spark):
    """Every window of an item's length, the bags of its five-word shingles, the best one: the same rows. Near the least similarity a
    fingerprint may lie beyond the radius, so rows below 0.85 may be missing, but none may be wrong."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(r.choice([12, 30, 50])))) for i in range(6)] + [(6, "only three words"), (7, None)]
    docs = []
    for i in range(60):
        t = [word() for _ in range(r.randrange(80))]
        if i % 2:
            own = (items[r.randrange(7)][1]).split()
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = word()
            t[5:5] = own
        docs.append((i, " ".join(t).upper() if i % 5 == 0 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1])]
    want = {}
    for d, t in docs:
        w = words(t)
        for n, text in items:
            own = words(text)
            if not own or not w:
                continue
            k = min(5, len(own))
            bag = lambda x: collections.Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            a = bag(own)
            for at in range(max(1, len(w) - len(own) + 1)):
                b = bag(w[at : at + len(own)])
                s = sum((a & b).values()) / max(1, sum((a | b).values()))
                if s >= 0.8 and s > want.get((d, n), (0, 0))[0]:
                    want[d, n] = (s, at)
    rows = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): (x.similarity, x.first_word) for x in rows}
    assert len(rows) == len(got) + 1  # the row that repeats
    assert {k: v for k, v in want.items() if v[0] >= 0.85} == {k: v for k, v in got.items() if v[0] >= 0.85} and len(got) > 12
    assert all(want[k] == v for k, v in got.items())
