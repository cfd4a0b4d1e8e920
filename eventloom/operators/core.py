"""Operators of the event algebra: DataFrame in, DataFrame out. Those that depend on arrival take the order as a column."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.paths import Scope, strings
from ..plans.expr import Value, _java, compile_filter, compile_value, conjunction

URL = r"https?://\S+|www\.\S+"

#: English words that are no topics, unless a caller has a list of its own (extract, `stop`).
STOPWORDS = """a about after all also am an and any are as at be because been before being but by can could did do does
for from had has have he her here him his how i if in into is it its just like me more most my new no not now of on one
only or other our out over she should so some than that the their them then there these they this to too up us was we were
what when where which while who why will with would you your""".split()


def select(df: DataFrame, *specs: str) -> DataFrame:
    """NAME, NAME=PATH or NAME=P1|P2: the first path that is there and not null; a bare path is named by its last part."""
    scope, out, names = Scope(df), [], []
    for spec in specs:
        name, eq, paths = spec.partition("=")
        paths = paths if eq else name
        name = name if eq else name.rpartition(".")[2]
        if name in names:
            raise ValueError(f"select: {name} is there twice")
        names.append(name)
        found = [v for v in (scope.find(p.strip()) for p in paths.split("|")) if v.kind not in ("missing", "null")]
        kinds = {v.kind for v in found}
        cols = [v.col if len(kinds) == 1 else V.text(v) for v in found]
        out.append((F.coalesce(*cols) if len(cols) > 1 else cols[0] if cols else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def where(df: DataFrame, expression: str | None = None, field: str | None = None, eq=None, ne=None, gt=None, lt=None, contains=None) -> DataFrame:
    """Rows for which the expression is true, or for which all given tests of one field are."""
    if (expression is None) == (field is None):
        raise ValueError("filter takes an expression or a field")
    if expression is not None:
        return df.filter(compile_filter(expression, df))
    v, lit = Scope(df).find(field), lambda x: V.value_of(F.lit(x), {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(x), T.StringType()))
    tests = [(eq, lambda x: V.equal(v, x)), (ne, lambda x: ~V.equal(v, x)), (gt, lambda x: V.ordered(">", v, x)), (lt, lambda x: V.ordered("<", v, x)), (contains, lambda x: V.holds(v, x))]
    return df.filter(conjunction([f(lit(x)) for x, f in tests if x is not None]))


def assign(df: DataFrame, *assignments: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """NAME=EXPRESSION in turn, each seeing those before; a.b makes or changes a struct; drops come last."""
    for a in assignments:
        name, eq, source = a.partition("=")
        if not eq:
            raise ValueError(f"map: {a!r} is not NAME=EXPRESSION")
        col, parts = compile_value(source, df).col, name.strip().split(".")
        if len(parts) == 1:
            df = df.withColumn(parts[0], col)
        elif parts[0] in df.columns and isinstance(df.schema[parts[0]].dataType, T.StructType):
            df = df.withColumn(parts[0], F.col(parts[0]).withField(".".join(parts[1:]), col))
        else:
            df = df.withColumn(parts[0], reduce(lambda c, p: F.struct(c.alias(p)), reversed(parts[1:]), col))
    for d in drop:
        head, _, rest = d.partition(".")
        if rest and head in df.columns:
            df = df.withColumn(head, F.col(head).dropFields(rest))
        else:
            df = df.drop(d)
    return df


def _texts(df: DataFrame, fields: tuple[str, ...]) -> Column:
    if fields:
        parts = [F.array(V.text(v)) if v.kind != "list" else v.col.cast("array<string>") for v in map(Scope(df).find, fields) if v.kind != "missing"]
    else:
        parts = [s for f in df.schema.fields for s in strings(F.col(f"`{f.name}`"), f.dataType)]
    return F.filter(F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull())), lambda t: t.isNotNull()) if parts else F.array().cast("array<string>")


def grep(df: DataFrame, *patterns: str, field: tuple[str, ...] = (), regex: bool = False, substring: bool = False, case_sensitive: bool = False, invert: bool = False) -> DataFrame:
    """Rows of which a text matches one of the patterns: as whole words, whatever the case, not inside URLs, unless told otherwise."""
    if not patterns:
        raise ValueError("grep needs a pattern")
    quoted = [p if regex else re.sub(r"([^\w\s])", r"\\\1", p) for p in patterns]
    parts = [q if regex or substring else rf"(?<!\w){q}(?!\w)" for q in quoted]
    pattern = _java("|".join(f"(?:{p})" for p in parts))
    if not case_sensitive:
        pattern = pattern.replace("(?U)", "(?iU)", 1)
    skip_urls = not regex and not any(c in p for p in patterns for c in "./")
    found = F.exists(_texts(df, field), lambda t: (F.regexp_replace(t, f"(?i){URL}", " ") if skip_urls else t).rlike(pattern))
    return df.filter(~found if invert else found)


def identity(df: DataFrame, by: tuple[str, ...] = (), key: str = "key") -> Column:
    """What makes a row the same thing: the given fields, else its key, else all its data."""
    scope = Scope(df)
    if by:
        return F.sha2(F.to_json(F.struct(*[V.text(scope.find(p)).alias(f"f{i}") for i, p in enumerate(by)]), {"ignoreNullFields": "false"}), 256)
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    return F.coalesce(F.col(key).cast("string"), whole) if key in df.columns else whole


def dedupe(df: DataFrame, *by: str, order: str) -> DataFrame:
    """The first row, by `order`, of each identity. min_by keeps one row for each key before the shuffle, so a key that
    holds a third of all rows is no hot spot, as it would be in a window."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    first = df.groupBy(identity(df, by).alias("_identity")).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row"))
    return first.select("_row.*")


def sort_keys(df: DataFrame, by: tuple[str, ...], reverse: bool = False, order: str | None = None) -> list[Column]:
    """Numbers and numeric text first by size, then text whatever its case, then what is missing; rows without the first
    field are last either way; equal rows keep their order."""
    out, scope = [], Scope(df)
    for i, path in enumerate(by):
        v = scope.find(path)
        n = V.number(v) if v.kind != "str" else F.when(V.strip(v.col).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), V.strip(v.col).try_cast("double"))
        n = F.when(v.col, 1.0).otherwise(0.0) if v.kind == "bool" else n
        absent = v.col.isNull() if v.kind != "missing" else F.lit(True)
        rank = F.when(absent, 2).when(n.isNotNull(), 0).otherwise(1)
        word = F.when(n.isNull(), V.fold(V.text(v)))
        if i == 0:
            out.append(absent.asc())
        out += [c.desc() if reverse else c.asc() for c in (rank, n, word)]
    return out + ([F.col(order).asc()] if order else [])


def sort(df: DataFrame, *by: str, reverse: bool = False, order: str | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(df, by or ("timestamp",), reverse, order))


def limit(df: DataFrame, count: int, order: str) -> DataFrame:
    """The first rows by `order`: a top-k, not a sort."""
    return df.orderBy(order).limit(count)


def union(*dfs: DataFrame) -> DataFrame:
    """All rows of all sources; a column that a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_first(key: str, *dfs: DataFrame) -> DataFrame:
    """One row for each key, from the first source that has it (within a source, the smallest row)."""
    cols = dfs[0].columns
    whole = union(*[d.withColumn("_source", F.lit(i)) for i, d in enumerate(dfs)])
    return whole.groupBy(key).agg(F.min(F.struct("_source", *[c for c in cols if c != key])).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in cols if c != key])


#: Pattern, case and mark of what can be asked for by name.
PRESETS = {
    "hashtags": (r"(?<![\w#])#([A-Za-z_]\w{1,49})", F.lower, "#"),
    "cashtags": (r"(?<![\w$])\$([A-Za-z]{1,6})(?!\w)", F.upper, "$"),
    "domains": (r"https?://(?:www\.)?([^/\s:?#]+)", F.lower, ""),
    "words": (r"(?<![\w'])([A-Za-z][A-Za-z'+-]*[A-Za-z+])", F.lower, ""),
}
#: Links, bare domains and names of people are no words.
NOT_WORDS = r"(?i)(?:https?://|www\.)\S+|@[\w.-]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/\S*)?"


def extract(df: DataFrame, what: str, field: tuple[str, ...] = ("title", "summary", "text"), into: str | None = None, keep_case: bool = False, stop: list[str] = STOPWORDS) -> DataFrame:
    """A new array column: the different matches of a preset or a regular expression (its first group, if any), in order. stop: words
    that the preset "words" leaves out, in lower case; a short English list by default."""
    pattern, case, prefix = PRESETS.get(what, (what, None, ""))
    texts = _texts(df, field)
    if what in PRESETS and what != "domains":
        texts = F.transform(texts, lambda t: F.regexp_replace(t, NOT_WORDS, " "))
    group = 1 if re.compile(pattern).groups else 0
    got = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(_java(pattern)), group)))
    if case and not keep_case:
        got = F.transform(got, case)
    if what == "words":
        got = F.filter(got, lambda w: ~F.lower(w).isin(list(stop)))
    got = F.array_distinct(F.filter(got, lambda w: w != ""))
    return df.withColumn(into or what, F.transform(got, lambda w: F.concat(F.lit(prefix), w)) if prefix else got)


# Windowed counting and spikes ---------------------------------------------------------------------------------------


def count(df: DataFrame, by: str, every: int | None = None, top: int | None = None, distinct: str | None = None, time: str = "ts", order: str = "event_id") -> DataFrame:
    """window_start, window_end, value, count, rank, events, values, truncated, complete: how often each value of `by` (each
    element of a list) stands in each window of `every` seconds, or in all rows; with `distinct`, how many values of it.

    Ties go to the value seen first. events counts rows without a value too. A window is incomplete if the data start after
    its first tenth, or end before its last. Totals come from one row for each window, never from a single task of rows.
    """
    v = Scope(df).find(by)
    items = F.transform(v.col, lambda x: x.cast("string")) if v.kind == "list" else F.array(V.text(v))
    ts = F.col(time).cast("timestamp")
    t = F.unix_micros(ts)
    start = F.floor(t / (every * 1e6)).cast("long") * every if every else F.lit(0).cast("long")
    rows = df.select(start.alias("w"), t.alias("t"), F.filter(items, lambda x: x.isNotNull() & (x != "")).alias("items"), F.col(order).alias("o"), (V.text(Scope(df).find(distinct)) if distinct else F.lit(None).cast("string")).alias("d"))
    spans = rows.groupBy("w").agg(F.count(F.lit(1)).alias("events"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    single = rows.select("w", F.explode("items").alias("value"), "o", "d")
    how = F.countDistinct(F.coalesce("d", F.col("o").cast("string"))) if distinct else F.count(F.lit(1))
    counts = single.groupBy("w", "value").agg(how.alias("count"), F.min("o").alias("first"))
    spans = spans.join(counts.groupBy("w").agg(F.count(F.lit(1)).alias("_kinds")), "w")
    order = (F.desc("count"), "first", "value")
    if top is not None and not every:  # one window: only what is asked for is ranked
        counts = counts.orderBy(*order).limit(top)
    ranked = counts.select("*", F.row_number().over(Window.partitionBy("w").orderBy(*order)).alias("rank"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    ends = spans.agg(F.min("lo").alias("first_t"), F.max("hi").alias("last_t"))
    out = ranked.join(spans, "w").join(F.broadcast(ends))  # one row
    if every:
        size = every * 1_000_000
        complete = (F.col("first_t") <= F.col("w") * 1_000_000 + F.lit(size // 10)) & (F.col("last_t") >= F.col("w") * 1_000_000 + F.lit(size - size // 10))
        lo, hi = F.timestamp_micros(F.col("w") * 1_000_000), F.timestamp_micros(F.col("w") * 1_000_000 + size)
    else:
        complete, lo, hi = F.lit(True), F.timestamp_micros("lo"), F.timestamp_micros("hi")
    kinds = F.col("_kinds") if top is None else F.least("_kinds", F.lit(top))
    return out.select(V.iso(lo).alias("window_start"), V.iso(hi).alias("window_end"), "value", "count", "rank", "events", kinds.alias("values"), (F.col("_kinds") > kinds).alias("truncated"), complete.alias("complete"))


def trend(counts: DataFrame, history: int = 6, min_count: int = 3, min_change: float = 100.0) -> DataFrame:
    """Values that rise: window_start, value, count, baseline (mean over up to `history` complete windows before), change_pct,
    title, rank. A window's absent value counts as its least kept count if it was truncated, else 0. The first window only counts."""
    whole = counts.filter("complete").select("window_start", "value", "count", "truncated")
    floors = whole.groupBy("window_start").agg(F.when(F.max("truncated"), F.min("count")).otherwise(0).alias("floor"))
    # one row a window: numbering them is small
    numbered = floors.withColumn("n", F.row_number().over(Window.orderBy("window_start")))
    now = whole.join(numbered.select("window_start", "n"), "window_start")
    steps = now.select("window_start", "value", "count", "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - history), F.col("n") - 1)).alias("p")).filter("n > 1")
    past = now.select("value", F.col("n").alias("p"), F.col("count").alias("c"))
    filled = steps.join(past, ["value", "p"], "left").join(numbered.select(F.col("n").alias("p"), "floor"), "p").withColumn("c", F.coalesce("c", "floor"))
    out = filled.groupBy("window_start", "value", "count").agg(F.avg("c").alias("baseline"))
    out = out.withColumn("change", (F.col("count") - F.col("baseline")) / F.greatest(F.col("baseline"), F.lit(1.0)) * 100)
    out = out.filter((F.col("count") >= min_count) & (F.col("change") >= min_change))
    label = F.when(F.col("baseline") == 0, F.lit("new")).otherwise(F.concat(F.lit("+"), F.rint("change").cast("long").cast("string"), F.lit("%")))
    w = Window.partitionBy("window_start").orderBy(F.desc("change"), F.desc("value"), F.desc("count"))
    return out.select("window_start", "value", "count", F.round("baseline", 2).alias("baseline"), F.round("change", 1).alias("change_pct"), F.concat_ws(" ", "value", label).alias("title"), F.row_number().over(w).alias("rank"))


# Change detection ---------------------------------------------------------------------------------------------------


def _leaves(kind, path: str) -> list[str]:
    return [x for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}")] if isinstance(kind, T.StructType) else [path]


CHANGE = "array<struct<path:string,old:string,new:string>>"


def _inside(a, b) -> list[tuple] | None:
    """What two JSON values hold under the same names: of objects, or of lists of as many objects by position; None if they are compared as wholes."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [(k, a.get(k), b.get(k)) for k in {**a, **b}]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b) and all(isinstance(x, dict) for x in a + b):
        return [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return None


def _changed(a, b, path: str) -> list[tuple]:
    pairs = _inside(a, b)
    if pairs is None:
        shown = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        return [] if a == b else [(path, shown(a), shown(b))]
    return [c for k, x, y in pairs for c in _changed(x, y, f"{path}.{k}" if path else str(k))]


def differences(old: Column, new: Column, path: str = "") -> Column:
    """path, old, new of all that differs between two JSON texts (of VARIANT values: to_json of them), down to the values inside. A key that one
    side lacks is null there; lists of as many objects are compared by position, other lists, and values of unlike kinds, as wholes. Only
    rows whose texts differ reach Python; a null text is JSON's null, and one that is no JSON a string."""
    differs = ~old.eqNullSafe(new)

    @F.pandas_udf(CHANGE)
    def found(a: pd.Series, b: pd.Series, on: pd.Series) -> pd.Series:
        def value(t):
            try:
                return None if t is None else json.loads(t)
            except ValueError:
                return t

        return pd.Series([_changed(value(x), value(y), path) if go else None for x, y, go in zip(a, b, on, strict=True)])

    got = found(F.when(differs, old), F.when(differs, new), differs)
    got = F.transform(got, lambda c: F.struct(F.when(c["path"] == "", "value").otherwise(c["path"]).alias("path"), c["old"].alias("old"), c["new"].alias("new")))
    return F.coalesce(got, F.array().cast(CHANGE))


def diff(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...], ignore: tuple[str, ...] = (), only: tuple[str, ...] = (), fetched: str | None = None, remember: bool = False) -> DataFrame:
    """key, change, fields: what was added, modified (with each field's old and new text) or removed between two snapshots.

    Fields of structs and VARIANT values are compared one by one, under their paths (see differences); lists of other types as a whole. With
    `fetched`, a row is removed only if its source was read this time; `remember` keeps rows that are gone."""
    variant = [f for f in fields if f in new.columns and isinstance(new.schema[f].dataType, T.VariantType) and f not in ignore]
    old, new = (x.withColumns({f: F.to_json(f) for f in variant}) for x in (old, new))
    names = [p for f in fields for p in _leaves(new.schema[f].dataType if f in new.columns else None, f) if f not in ignore and p not in ignore]
    a = old.select(key, *([fetched] if fetched else []), F.struct(*[F.col(f).alias(f) for f in names]).alias("a"))
    b = new.select(key, F.struct(*[F.col(f).alias(f) for f in names]).alias("b"))
    plain = lambda f: F.filter(F.array(F.struct(F.lit(f).alias("path"), F.col(f"a.`{f}`").cast("string").alias("old"), F.col(f"b.`{f}`").cast("string").alias("new"))), lambda _: ~F.col(f"a.`{f}`").eqNullSafe(F.col(f"b.`{f}`")))
    inner = lambda f: F.filter(differences(F.col(f"a.`{f}`"), F.col(f"b.`{f}`"), f), lambda c: ~c["path"].isin(list(ignore)))
    changed = F.concat(*[inner(f) if f in variant else plain(f) for f in names])
    both = a.join(b, key, "full_outer")
    both = both.withColumn("_fields", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size("_fields") > 0, "modified")
    out = both.withColumn("change", change).filter("change is not null")
    if fetched:
        seen = new.select(fetched).distinct().withColumnRenamed(fetched, "_read")
        out = out.join(seen, out[fetched] == seen["_read"], "left").filter((F.col("change") != "removed") | F.col("_read").isNotNull())
    if remember:
        out = out.filter("change <> 'removed'")
    if only:
        out = out.filter(F.col("change").isin(*only))
    return out.select(key, "change", F.when(F.col("change") == "modified", F.col("_fields")).alias("fields"))
