"""Line dedup with a fixed-depth template tree, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_BYTES, discard, sided, stored

BLANK = " \t\r\f\x0B"
S = "[ \\t\\r\\f\\x0B]"


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, long: int) -> DataFrame:
    """Each line of min_tokens or more: its document, place, tokens, leaf of the tree, a 128-bit hash of its tokens with those that
    have a digit as <*>, and, for `long` tokens or more, one of its own tokens. A line is hashed and counted as one string with single spaces."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    lines = rows.select("d", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    # The only filter stands on the line as it is: one on what follows would be pushed down and make all of it twice.
    lines = lines.filter(F.col("line").rlike(f"^{S}*+(?:[^{S[1:-1]}]++{S}++){{{min_tokens - 1}}}[^{S[1:-1]}]"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANK)))
    lines = lines.withColumn("line", _single_spaces(F.col("line"))).withColumn("masked", _masked(F.col("line")))
    lines = lines.withColumn("n", F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    own = lambda *x: F.when(F.col("n") >= long, F.xxhash64(*x, "line"))
    return lines.select("d", "th", "pos", "n", F.xxhash64("n", F.substring_index("masked", " ", depth)).alias("leaf"), F.xxhash64("masked").alias("h1"), F.xxhash64(F.lit(1), "masked").alias("h2"), own().alias("x1"), own(F.lit(1)).alias("x2"))


def _single_spaces(line: Column) -> Column:
    return F.when(line.rlike("[\\t\\r\\f\\x0B]|  "), F.regexp_replace(line, f"{S}+", " ")).otherwise(line)


def _masked(line: Column) -> Column:
    """Tokens with a digit as <*>; a line without one is left as it is."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def _tokens(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, wide: int, min_docs: int) -> DataFrame:
    """leaf, h1, h2, p, token of the different lines of leaves that have min_docs of them. One place of each is looked up in its text."""
    line = ["leaf", "h1", "h2"]
    some = known.filter(F.col("n") >= wide)
    leaves = some.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter((F.col("k") >= min_docs) & (F.col("lo") != F.col("hi"))).select("leaf")
    different = stored(some.join(sided(stored(leaves, "leaves"), 16), "leaf", "left_semi").groupBy(*line).agg(F.min(F.struct("d", "th", "pos")).alias("at")), "different")
    full = different.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") >= min_docs).select("leaf")
    places = stored(different.join(full, "leaf", "left_semi"), "places")
    own = places.groupBy(F.col("at.d").alias("ld"), F.col("at.th").alias("lth")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), *line)).alias("own"))
    own = F.broadcast(own) if places.limit(BROADCAST_BYTES // 96 + 1).count() <= BROADCAST_BYTES // 96 else own
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = rows.join(own, rows.d.eqNullSafe(F.col("ld")) & (F.xxhash64(rows.t) == F.col("lth"))).select(F.split("t", "\n").alias("lines"), "own")
    found = found.select("lines", F.explode("own").alias("o")).select(*[f"o.{c}" for c in line], F.get("lines", F.col("o.pos")).alias("line"))
    found = found.withColumn("line", F.btrim("line", F.lit(BLANK)))
    masked = found.select(*line, _masked(_single_spaces(F.col("line"))).alias("m")).dropDuplicates(line)  # a row may stand there twice
    tokens = stored(masked.select(*line, F.posexplode(F.split("m", " ")).alias("p", "token")), "line-tokens")
    discard(different, places)
    return tokens


def _generalised(tokens: DataFrame, alike: float, min_docs: int, templates: int | None) -> DataFrame:
    """leaf, h1, h2, nth of lines that fit the nth template of their leaf. A template: at each place the token that most of the leaf's
    different lines have there (min_docs of them at least; ties to the smaller) is constant; a line fits if `alike` of its tokens
    are constants. The next template is that of the lines that fit none before it, until none fits or `templates` are found (None: no limit).
    A leaf is out of the rounds once nothing of it fits, as its lines would be the same in the next one."""
    line, fits, nth, left, written = ["leaf", "h1", "h2"], [], 0, tokens, []
    while templates is None or nth < templates:
        per = left.groupBy("leaf", "p", "token").agg(F.count(F.lit(1)).alias("c"))
        best = per.groupBy("leaf", "p").agg(F.min(F.struct((-F.col("c")).alias("c"), "token")).alias("b")).select("leaf", "p", F.col("b.token").alias("token"), (-F.col("b.c")).alias("c"))
        constant = best.filter(F.col("c") >= min_docs).select("leaf", "p", "token", F.lit(1).alias("same"))
        fit = left.join(constant, ["leaf", "p", "token"], "left").groupBy(*line).agg(F.count(F.lit(1)).alias("n"), F.count("same").alias("same"))
        fits.append(stored(fit.filter(F.col("same") >= F.ceil(F.col("n") * F.lit(alike))).select(*line, F.lit(nth).alias("nth")), "fit"))
        if fits[-1].isEmpty():
            break
        nth += 1
        rest = left.join(sided(fits[-1].select("leaf").distinct(), 16), "leaf", "left_semi").join(sided(fits[-1]), line, "left_anti")
        if nth % 3 == 0:  # so that neither the rows of a round nor the list of rounds go back to all before it
            rest, done = stored(rest, "left"), stored(reduce(DataFrame.unionByName, fits), "fit")
            discard(*fits, *written)
            fits, written = [done], [rest]
        left = rest
    return reduce(DataFrame.unionByName, fits)


def repeated(docs: DataFrame, depth: int = 3, min_tokens: int = 3, wide: int = 6, alike: float = 0.8, min_docs: int = 5, templates: int | None = None, long: int = 20, long_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, th, drop: for each text that has some, the places of its lines that recur across documents."""
    known = stored(_lines(docs, id_col, text_col, depth, min_tokens, long), "lines")
    tokens = _tokens(docs, known, id_col, text_col, wide, min_docs)
    fit = stored(_generalised(tokens, alike, min_docs, templates), "fits")
    # A line's template: the nth of its leaf if it fits that, else its own tokens. A long line also stands for itself.
    named = known.join(sided(fit), ["leaf", "h1", "h2"], "left").select("d", "th", "pos", F.coalesce("nth", F.lit(-1)).alias("kind"), F.when(F.col("nth").isNull(), F.col("h1")).otherwise(F.col("leaf")).alias("a"), F.when(F.col("nth").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("b"))
    drops = stored(_drops(named.unionByName(_itself(known)), F.when(F.col("kind") == -2, long_docs).otherwise(min_docs)), "drops")
    discard(known, tokens, fit)
    return drops


def _itself(known: DataFrame) -> DataFrame:
    return known.filter("x1 is not null").select("d", "th", "pos", F.lit(-2).alias("kind"), F.col("x1").alias("a"), F.col("x2").alias("b"))


def _drops(named: DataFrame, min_docs: Column) -> DataFrame:
    """d, th, drop: the places of lines whose template (kind, a, b) stands in min_docs documents, save the first."""
    template = ["kind", "a", "b"]
    in_docs = named.groupBy(*template, "d").agg(F.min(F.struct("pos", "th")).alias("first"))
    recur = in_docs.groupBy(*template).agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("d", "first")).alias("first")).filter(F.col("docs") >= min_docs)
    recur = stored(recur.select(*template, F.col("first.d").alias("fd"), F.col("first.first.pos").alias("fpos"), F.col("first.first.th").alias("fth")), "recurring")
    first = F.col("d").eqNullSafe(F.col("fd")) & (F.col("pos") == F.col("fpos")) & (F.col("th") == F.col("fth"))
    return named.join(sided(recur, 80), template).filter(~first).groupBy("d", "th").agg(F.collect_set("pos").alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with its columns and rows, the text without lines of recurring templates, and n_lines and n_dropped.

    Lines are what line feeds separate, tokens what white space separates. The tree's path is the token count and the first
    `depth` tokens; tokens with a digit are variable (<*>). In a leaf, lines of `wide` tokens or more that fit one of the leaf's
    templates (see _generalised; all there are, or the first `templates`) have that template, any other line has its own tokens. A template in `min_docs` documents
    recurs, and so does a line of `long` tokens or more that stands, digits too, in `long_docs`: its lines go, save the first one
    (smallest id, null first, then place), so that one copy of a passage stays. Lines of fewer than min_tokens tokens stay. A null
    text stays null with 0 lines. Rows with the same id are one document; equal rows lose the same lines. An own column n_lines or
    n_dropped is replaced; an empty table gives no rows.
    """
    return _without(docs, repeated(docs, id_col=id_col, text_col=text_col, **parameters), id_col, text_col)


def passages(docs: DataFrame, min_tokens: int = 20, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As dedup, but only lines of min_tokens tokens or more, and each its own tokens, digits too: those in min_docs documents
    go, save the first one. For a corpus whose copies of whole documents are gone, as the first copy of a line may be in any document."""
    known = stored(_lines(docs, id_col, text_col, 3, min_tokens, min_tokens), "passages")
    drops = stored(_drops(_itself(known), F.lit(min_docs)), "drops")
    discard(known)
    return _without(docs, drops, id_col, text_col)


def _without(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    free = [f"_{x}" for x in ("d", "th", "drop", "lines")]
    while set(free) & set(docs.columns):
        free = [f"_{x}" for x in free]
    d, th, drop, lines = free
    text = F.col(f"`{text_col}`").cast("string")
    drops = drops.withColumnsRenamed({"d": d, "th": th, "drop": drop}).hint("shuffle_hash")
    kept = docs.join(drops, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(th)), "left").withColumn(lines, F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    new = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    out = kept.withColumns({"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)), "n_dropped": F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)), text_col: new})
    return out.drop(*free)


def _oracle(rounds: int = 3) -> str:
    """The same as DuckDB SQL."""
    parts, left = "", "t"
    for i in range(rounds):
        parts += f"""c{i} AS (SELECT leaf, p, token, count(*) AS c FROM {left} GROUP BY ALL),
best{i} AS (SELECT * FROM c{i} QUALIFY row_number() OVER (PARTITION BY leaf, p ORDER BY c DESC, token) = 1),
fit{i} AS (SELECT x.leaf, x.own, {i} AS nth FROM {left} x LEFT JOIN (FROM best{i} WHERE c >= 5) b USING (leaf, p, token) GROUP BY ALL HAVING count(b.c) >= ceil(count(*) * 0.8)),
t{i} AS (SELECT * FROM {left} WHERE (leaf, own) NOT IN (SELECT leaf, own FROM fit{i})),
"""
        left = f"t{i}"
    return BEFORE + parts + f"fit AS ({' UNION ALL '.join(f'FROM fit{i}' for i in range(rounds))}),\n" + AFTER


BEFORE = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM rows),
s AS (SELECT r, doc_id, pos, list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\v]+'), lambda t: t <> '') AS plain FROM l),
m AS (SELECT r, doc_id, pos, plain, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM s),
k AS (SELECT *, len(tokens) AS n, (len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:3], ' ')) AS leaf, array_to_string(tokens, ' ') AS own FROM m WHERE len(tokens) >= 3),
u AS (SELECT leaf, own, tokens FROM k WHERE n >= 6 GROUP BY ALL),
leaves AS (SELECT leaf FROM u GROUP BY leaf HAVING count(*) >= 5),
t AS (SELECT leaf, own, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM u WHERE leaf IN (FROM leaves)),
"""
AFTER = """named AS (SELECT k.*, CASE WHEN fit.own IS NULL THEN 'line ' || k.own ELSE 'leaf ' || nth || ' ' || k.leaf END AS template FROM k LEFT JOIN fit USING (leaf, own)),
both_ AS (SELECT r, doc_id, pos, template, 5 AS least FROM named UNION ALL SELECT r, doc_id, pos, 'itself ' || array_to_string(plain, ' '), 2 FROM k WHERE n >= 20),
recur AS (SELECT template FROM both_ GROUP BY template HAVING count(DISTINCT doc_id) >= min(least)),
marked AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) AS nth FROM both_ WHERE template IN (FROM recur)),
gone AS (SELECT DISTINCT r, pos FROM marked WHERE nth > 1),
kept AS (SELECT l.r, string_agg(CASE WHEN gone.r IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text, count(*) AS n_lines, count(gone.r) AS n_dropped FROM l LEFT JOIN gone USING (r, pos) GROUP BY l.r)
SELECT doc_id, coalesce(kept.text, CASE WHEN rows.text IS NOT NULL THEN '' END) AS text, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_dropped, 0)::INTEGER AS n_dropped FROM rows LEFT JOIN kept USING (r)
"""

ORACLE = _oracle()
