"""One row of each group of near copies, with null and repeated ids."""

import random


def test_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    r = random.Random(7)
    a, b, c, d, e, f = (" ".join(f"{r.choice('bcdfg')}{r.randint(0, 9999)}" for _ in range(80)) for _ in range(6))
    rows = [
        (None, a), (None, a), (None, a + " end"),  # copies and a near copy without id: one stays
        (None, b), (1, b),  # a number comes first
        (2, c), (3, c), (3, d),  # a clean text of a repeated id stays
        (4, e), (4, e + " end"),  # near copies under one id
        (5, f), (5, f), (6, None), (6, None), (7, ""), (8, ""), (None, None), (None, ""),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = P.one_of_each_group(spark, df, None)
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert out.columns == df.columns and len(got) == len(set(got)) == 11
    assert sum(i is None and bool(t) for i, t in got) == 1 and {(1, b), (2, c), (3, d), (5, f), (6, None), (7, ""), (8, ""), (None, None), (None, "")} <= set(got)
    assert sum(i == 4 for i, _ in got) == 1
    assert P.one_of_each_group(spark, df.limit(0), None).count() == 0
