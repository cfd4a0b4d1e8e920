"""Long lines in two documents against plain Python."""

from eventloom.llm import linededup


def test_long_lines_in_two_documents(spark, tmp_path):
    import corpus_pipeline as P

    long = " ".join(f"w{i}" for i in range(55))
    other = long.replace("w7 ", "w8 ")
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (None, f"{other}\nx"), (3, f"{other}\n{other}"), (4, None), (5, f"{long[:30]}\n{long[:30]}"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.passages(df).collect()}
    assert got == {1: (f"a\n{long}\nb", 0), 2: ("c\nd", 1), None: (f"{other}\nx", 0), 3: ("", 2), 4: (None, 0), 5: (rows[5][1], 0), 6: ("", 0)}
    assert linededup.passages(df.limit(0)).count() == 0
    spark.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id: r.text for r in P.clean_of_benchmarks(spark, df, str(tmp_path)).collect()}
    assert left[1] == f"a\n{long}\nb" and left[2] == "c\nd" and 3 not in left
