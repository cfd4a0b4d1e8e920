"""Quality trees, the language model, shards, search and the pipeline on small tables."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_text import words

from eventloom.llm import brown, quality, shards, topk


def documents(spark, n=120, seed=1):
    r = random.Random(seed)
    nouns = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sta", "vel", "x")]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(r.choice(nouns) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(20, 90))) if good else " ".join(r.choice(nouns).upper() + r.choice(["!!", "%%%", "###"]) for _ in range(r.randint(20, 90)))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 5 < 4:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(spark):
    docs, labels = documents(spark)
    model = quality.train(docs, labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**6, 1, 0)], labels.schema)))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 120
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) == int(i % 3 > 0)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (2, "", 0.5), (3, "é" * 200_000, 0.5), (4, "\n \n", 0.5)], "doc_id long, text string, score double")
    assert quality.score(odd, model).count() == 6
    assert quality.score(odd.limit(0), model).count() == 0
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 3}
    numbers = docs.selectExpr("doc_id as text", "'x' as _text")
    assert quality.accepted(numbers, model).columns == ["text", "_text"] and quality.accepted(numbers, model, threshold=0.0).count() == 120
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


def test_trees_against_plain_recursion():
    """Level-by-level traversal of the arrays gives what walking each tree does, and boosting lowers the loss with each tree."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    inner = model.feature.shape[1]

    def walk(t, row, node=0):
        if node >= inner:
            return model.leaf[t, node - inner]
        return walk(t, row, 2 * node + (1 if row[model.feature[t, node]] <= model.threshold[t, node] else 2))

    plain = [1 / (1 + math.exp(-model.prior - sum(walk(t, r) for t in range(20)))) for r in x]
    assert np.allclose(model.scores(x), plain)
    loss = [-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() for k in (0, 5, 20) for p in [quality.Trees(model.feature[:k], model.threshold[:k], model.leaf[:k], model.prior).scores(x)]]
    assert loss[0] > loss[1] > loss[2] and ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_statistics_do_not_depend_on_neighbours():
    from eventloom.llm import textkit as tk
    import pyarrow as pa

    texts = ["One two.\nOne two.\n\nX", "", "a a a a B", "É!! é ", "\n", "x" * 50, None]
    data, offs = tk.flat(pa.array(texts, pa.string()))
    together = quality.statistics(data, offs)
    alone = np.concatenate([quality.statistics(*tk.flat(pa.array([t], pa.string()))) for t in texts])
    assert together.shape == (7, len(quality.NAMES)) and np.allclose(together, alone) and np.isfinite(together).all()
    assert together[0, quality.NAMES.index("repeated_lines")] == 0.25 and together[2, quality.NAMES.index("top_word")] == np.float32(0.8)


def test_language_model(spark):
    docs, _ = documents(spark)
    more = spark.createDataFrame([(900, None), (901, ""), (None, "zz kasta"), (902, "Karen zzz " + "q" * 3000), (902, "Karen zzz " + "q" * 3000)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more)
    rows = df.collect()
    c = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for i, t in rows)
    for k in (8, 1000):
        got = brown.score(df, words=k, classes=6, rounds=3).collect()
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
        assert k == 8 or sum(r.score for r in held) > sum(r.base_score for r in held)
        assert all(r.score < 0 and r.perplexity > 1 for r in got)
    empty = brown.score(df.limit(0)).collect()
    assert empty == []
    assert brown.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().n_known == 0


def test_scores_against_a_plain_model(spark):
    """The same model with dictionaries and loops: places, contexts, exchange, class and word probabilities."""
    r = random.Random(8)
    some = ["the", "cat", "sat", "on", "a", "mat", "Dog", "ran", "far", "x" * 60]
    rows = [(i, " ".join(r.choice(some[:6]) if r.random() < 0.7 else r.choice([*some, f"rare{r.randrange(40)}"]) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(None, "the cat"), (3, None)]
    k, many, rounds = 5, 4, 2
    got = brown.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=k, classes=many, rounds=rounds).collect()
    train = [words(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    own = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if len(w.encode()) <= brown.WORD_BYTES][:k]
    end = k + brown.ENDINGS

    def place(w):
        return own.index(w) if w in own else k + int(brown.ending(pa.array([w.encode()], pa.large_binary()))[0])

    seqs = [[end, *map(place, t), end] for t in train]
    cls = np.append(np.arange(end) % (many - 1), many - 1)

    def contexts():
        after, before = np.zeros((end + 1, many)), np.zeros((end + 1, many))
        for s in seqs:
            for x, y in zip(s, s[1:]):
                after[x, cls[y]] += 1
                before[y, cls[x]] += 1
        return after, before

    for _ in range(rounds):
        cls = brown.exchange(cls, *contexts(), many)
    n, mass = np.zeros((many, many)), np.array([0.1] * many)
    np.add.at(n, cls, contexts()[0])
    for w, m in c.items():
        mass[cls[place(w)]] += m + 0.1
    mass[many - 1] = len(train) + 0.1
    share = brown.transitions(n, mass)

    def plain(t):
        total, last = 0.0, cls[end]
        for w in [*words(t), None]:
            now = cls[end if w is None else place(w)]
            total += share[last, now] + math.log10((len(train) if w is None else c[w]) + 0.1) - math.log10(mass[now])
            last = now
        return total

    want = collections.Counter((i, round(plain(t), 6)) for i, t in rows)
    assert collections.Counter((x.doc_id, round(x.score, 6)) for x in got) == want
    with pytest.raises(ValueError):
        brown.score(spark.createDataFrame(rows, "doc_id long, text string"), words=63_488)


def test_class_probabilities_sum_to_one(spark):
    """Over all known words, an unknown one of each class and the end, after any text."""
    texts = [(i, t) for i, t in enumerate(["a b a b c", "b a b a", "c c a b"] * 20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    c = collections.Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 10 for w in [*t.split(), None])
    n = np.array([[5.0, 2.0, 1.0], [0, 0, 3.0], [4, 4, 0]])
    mass = np.array([6.0, 3.0, 2.0])
    assert np.allclose((10 ** brown.transitions(n, mass)).sum(1), 1)
    rows = {r.doc_id: r for r in brown.score(df, words=3, classes=3, rounds=1).collect()}
    assert rows[0].n_known == 6 and c[None] > 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    truth = np.arange(40) % 4
    a = truth[:, None] * 0 + rng.integers(0, 3, (40, 40)) + 20 * ((truth[:, None] + 1) % 4 == truth[None, :])
    cls = np.append(rng.integers(0, 4, 39), 4)

    def contexts(cls):
        one = np.eye(5)[cls]
        return a @ one, a.T @ one

    def value(cls):
        n = np.eye(5)[cls].T @ a @ np.eye(5)[cls]
        return brown._xlogx(n).sum() - brown._xlogx(n.sum(0)).sum() - brown._xlogx(n.sum(1)).sum()

    first = value(cls)
    for _ in range(4):
        cls = brown.exchange(cls, *contexts(cls), 5)
    assert value(cls) > first and cls[-1] == 4


def test_shards(spark):
    r = random.Random(2)
    rows = [(i, "t" * r.randint(0, 9), r.choice(["hot", "hot", "a", "b", None])) for i in range(1000)] + [(5, None, "a"), (5, None, "a"), (None, "é", "c")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, rank int").repartition(4)
    got = shards.shard(df, group_rows=70).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    whole = collections.Counter(s for _, _, s in rows)
    for part in by.values():
        assert sorted(x.slot for x in part) == list(range(len(part)))
        mix = collections.Counter(x.source for x in part)
        assert all(abs(mix[s] - whole[s] * len(part) / len(rows)) <= 2 for s in whole)
    assert collections.Counter((x.doc_id, x.size, x.text_crc32) for x in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    key = lambda rs: sorted((x.place, x.doc_id if x.doc_id is not None else -1, x.shard, x.slot) for x in rs)
    assert key(shards.shard(df.repartition(2), group_rows=300).collect()) == key(got)
    alone = spark.range(3000).selectExpr("cast(null as long) doc_id", "cast(id as string) text", "'a' source")
    places = [x.place for x in shards.shard(alone, group_rows=100).collect()]
    assert sorted(places) == list(range(3000))
    assert shards.shard(df.limit(0)).count() == 0 and shards.shard(df.limit(3)).count() == 3


@pytest.mark.parametrize("blocks", [2, 100])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, rng.choice([3, 4, 4])) / 3]) for i in range(-100, 300)]
    rows += [(None, [1.0]), (400, None), (401, [1.0, float("nan")]), (402, [float("inf")]), (403, [None]), (404, []), (100, rows[200][1])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in {i: v for i, v in good if i % 100 == 0}.items():
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        want |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:10])}
    assert {tuple(r) for r in topk.search(df, query_block=blocks).collect()} == want
    assert topk.search(df.limit(0)).count() == 0


def test_large_scores_stay_exact():
    q = (np.array([0]), np.array([2]), np.array([1 << 40, -5]))
    c = (np.array([1, 2]), np.array([2, 1]), np.array([1 << 40, 7, 3]))
    assert topk.accumulate(q, c).tolist() == [[(1 << 80) - 35, 3 << 40]]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels = documents(spark)
    copy = docs.filter("doc_id in (1, 2, 4)").withColumn("doc_id", docs.doc_id + 1000)
    passage = " ".join(f"leak{i}" for i in range(40))
    leak = spark.createDataFrame([(2000, "karen lovel " * 9 + passage + " miren tusta." * 9, "en", "s1", 9)], docs.schema)
    docs.union(copy).union(leak).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    df, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, f) in enumerate(P.STAGES):
        df = f(spark, df, str(tmp_path))
        if i < 4:
            assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / f"s{i}"))
        df = spark.read.parquet(str(tmp_path / f"s{i}"))
        ids.append({r.doc_id for r in df.select("doc_id").collect()})
    good = {i for i in range(120) if i % 3}
    assert ids[0] == ids[1] == good | {1001, 1002, 1004, 2000}
    assert ids[2] == good | {2000} and ids[3] == ids[4] == good
    whole = P.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) and {r.doc_id for r in whole.collect()} == good
