"""The registered line dedup finds all templates of a leaf."""

import pytest

from eventloom.llm import linededup
from eventloom.llm.queries import QUERIES


def test_the_query_has_no_limit_of_templates(spark, tmp_path):
    """Five templates of one leaf, against the query's SQL with as many rounds as it takes, and with its three."""
    duckdb = pytest.importorskip("duckdb")
    family = lambda f, i: f"in this place {' '.join(f'{c}{chr(97 + f)}' for c in 'klmnop')} host-{'abcdefghij'[i]}"
    rows = [(100 * f + i, f"{family(f, i)}\nshort one") for f in range(5) for i in range(10 - f)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect())
    assert {r[0]: r[3] for r in got} == {d: int(d % 100 > 0) for d, _ in rows}
    duckdb.sql(f"create or replace view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(duckdb.sql(linededup._oracle(6)).fetchall())
    three = sorted(duckdb.sql(linededup.ORACLE).fetchall())
    assert [a for a, b in zip(got, three, strict=True) if a != b] == [r for r in got if r[0] > 300 and r[0] % 100]
