"""The operators over the tables they are for, with production parameters."""

from __future__ import annotations

from .filteraudit import ORACLE as FILTER_AUDIT
from .lexical import ORACLE as LEXICAL_SEARCH
from .linededup import ORACLE as LINE_DEDUP
from .runtime import table

QUERIES = {}
ORACLES = {"op5_line_dedup": LINE_DEDUP, "op11_filter_audit": FILTER_AUDIT, "op12_lexical_search": LEXICAL_SEARCH}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark, sf_dir):
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_quality(spark, sf_dir):
    from .quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op3_brown_lm(spark, sf_dir):
    from .brown import score

    return score(table(spark, sf_dir, "documents"))


@query
def op4_token_files(spark, sf_dir):
    from .tokenfiles import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op5_line_dedup(spark, sf_dir):
    from .linededup import dedup

    # All templates of a leaf. Its SQL stops at three, so they differ where lines fit a fourth one (none on sf0.1; on check_l 62 more go).
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op6_substring_dedup(spark, sf_dir):
    from .substrings import remove

    return remove(table(spark, sf_dir, "documents"))


# Two hex digits a byte: string i of a text is 400 of them.
ORACLES["op6_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, b, substr(h, 2 * b + 1, 1422) AS part FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 512)) AS b FROM d WHERE length(h) >= 400)),
w AS (SELECT r, b + j AS i, md5(substr(part, 2 * j + 1, 400)) AS w FROM (SELECT r, b, part, unnest(range(least(512, length(part) // 2 - 199))) AS j FROM c)),
t AS (SELECT w FROM w GROUP BY w HAVING count(*) > 1),
f AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, -1) AS new FROM w WHERE w IN (FROM t)),
n AS (SELECT r, i, sum(new::INTEGER) OVER (PARTITION BY r ORDER BY i) AS run FROM f),
s AS (SELECT r, run, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY r, run),
p AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM s),
k AS (SELECT p.r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS front, max(hi) AS last FROM p JOIN d USING (r) GROUP BY p.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


@query
def op7_sharding(spark, sf_dir):
    from .shards import shard

    return shard(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op9_topk(spark, sf_dir):
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"))


ORACLES["op9_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op10_jaccard_join(spark, sf_dir):
    from .jaccard import join_documents

    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op10_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
u AS (SELECT r, unnest(sh) AS t, len(sh) AS n FROM s),
p AS (SELECT a.r AS x, b.r AS y, min(a.n) AS m, min(b.n) AS n, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.r <> b.r GROUP BY a.r, b.r),
e AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 90 * (m + n - c)),
g AS (SELECT r, r AS o FROM w UNION SELECT g.r, e.y FROM g JOIN e ON g.o = e.x),
k AS (SELECT g.r, min(w.doc_id) AS component_id FROM g JOIN w ON g.o = w.r GROUP BY g.r)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN k USING (r)
"""


@query
def op11_filter_audit(spark, sf_dir):
    from .filteraudit import audit, standard_marks

    return audit(standard_marks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), list("ABCDE"), ["good", "toxic"])


@query
def op12_lexical_search(spark, sf_dir):
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_quality_rules(spark, sf_dir):
    from .rules import judge

    return judge(table(spark, sf_dir, "documents"))
