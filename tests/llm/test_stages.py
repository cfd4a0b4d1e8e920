"""Each stage of the pipeline on rows with nulls, blanks, repeats, long texts and columns whose names the operators use."""

import random

import pytest

NAMES = ["_row", "_d", "score", "held_out", "line", "token", "key", "node", "component_id", "th", "row"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("stages")
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage, footer = text(40), text(60), "All rights reserved by us in 2024"
    base = text(120)
    rows = [(i, "\n".join([text(60), footer, text(30)])) for i in range(30)]
    rows += [(100, base), (101, base), (101, base), (102, base + " end"), (None, base), (103, passage + "\n" + text(50)), (104, text(50) + "\n" + passage)]
    rows += [(105, text(20) + " " + item + " " + text(20)), (106, None), (107, ""), (108, " \n\t"), (None, None), (109, "word"), (110, text(120_000)), (110, text(5))]
    table = [(i, t, "en", "s", len(t or ""), *["x"] * len(NAMES)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), base, passage


def test_stages_take_odd_rows(spark, folder):
    import corpus_pipeline as P

    d, base, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect()), key=str)
    whole = key(docs)
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        if name == "packing":
            assert {x.doc_id for x in out.collect()} == {i if i >= 0 else None for i, _ in whole}
            continue
        assert out.columns == docs.columns, name
        got = key(out)
        if name == "line dedup":
            assert sum("All rights" in (t or "") for _, t in got) == 1 and (106, None) in got and (107, "") in got and (108, " \n\t") in got
        if name == "n-gram Jaccard join":
            assert sum((t or "").startswith(base) for _, t in got) == 1 and (100, base) in got
            assert len([x for x in got if x[0] in (106, 107, 108, 109, 110)]) == 6
        if name == "benchmark decontamination":
            assert 105 not in {i for i, _ in got} and sum(passage in (t or "") for _, t in got) == 1
        empty = stage(spark, docs.limit(0), d)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert P.packed_sequences(spark, docs.limit(0), d).count() == 0
