"""Values of schemaless rules over typed columns: truth, numbers in text, comparisons that are never null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what counts as a number in a text.
NUMERIC_TEXT = r"^\s*-?\d+(\.\d+)?\s*$"


@dataclass(frozen=True)
class Value:
    """A column with what is known of its type: num, int, str, bool, list, obj, null or missing."""

    kind: str
    col: Column
    item: str = "str"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.StructType, T.MapType)):
        return "obj"
    return "null" if isinstance(t, T.NullType) else "str"


def value_of(col: Column, t: T.DataType) -> Value:
    kind = kind_of(t)
    if kind == "list":
        return Value(kind, col, kind_of(t.elementType))
    return Value(kind, col.cast("string") if kind == "str" and not isinstance(t, (T.StringType, T.VariantType)) else col)


def null() -> Value:
    return Value("null", F.lit(None).cast("string"))


def number(v: Value) -> Column:
    """The value as a double if it is a number or text of one, else null. Booleans are not numbers."""
    if v.kind in ("num", "int"):
        return v.col.cast("double")
    if v.kind == "str":
        return F.when(v.col.rlike(NUMERIC_TEXT), F.trim(v.col).try_cast("double"))
    return F.lit(None).cast("double")


def text(v: Value) -> Column:
    """The value as text, booleans capitalised."""
    if v.kind == "bool":
        return F.when(v.col, F.lit("True")).when(~v.col, F.lit("False"))
    if v.kind in ("list", "obj"):
        return F.to_json(v.col)
    return v.col.cast("string")


def fold(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))


def truthy(v: Value) -> Column:
    """Empty, zero, false and null are false; never null."""
    if v.kind in ("null", "missing"):
        return F.lit(False)
    test = {"bool": lambda c: c, "num": lambda c: c != 0, "int": lambda c: c != 0, "str": lambda c: c != "", "list": lambda c: F.size(c) > 0}
    return F.coalesce(test.get(v.kind, lambda c: c.isNotNull())(v.col), F.lit(False))


def equal(a: Value, b: Value) -> Column:
    """Equal as numbers if both are numeric, else as the same kind of value; null equals null."""
    if "missing" in (a.kind, b.kind) or "null" in (a.kind, b.kind):
        return F.coalesce(a.col.isNull() & b.col.isNull(), F.lit(False))
    na, nb = number(a), number(b)
    both = na.isNotNull() & nb.isNotNull()
    same = {"num": "num", "int": "num"}.get(a.kind, a.kind) == {"num": "num", "int": "num"}.get(b.kind, b.kind)
    plain = a.col.eqNullSafe(b.col) if same else a.col.isNull() & b.col.isNull()
    if a.kind == b.kind and a.kind in ("bool", "list", "obj"):
        return plain
    return F.when(both, na == nb).otherwise(plain)


def ordered(op: str, a: Value, b: Value) -> Column:
    """Numbers by size, two texts by code point, anything else false."""
    act = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    na, nb = number(a), number(b)
    out = F.when(na.isNotNull() & nb.isNotNull(), act(na, nb))
    if a.kind == b.kind == "str":
        out = out.otherwise(act(a.col, b.col))
    return F.coalesce(out, F.lit(False))


def holds(a: Value, b: Value) -> Column:
    """List a has an element like b, or text a has the text b, whatever the case."""
    if a.kind == "list":
        return F.coalesce(F.exists(a.col, lambda x: _like(Value(a.item, x), b)), F.lit(False))
    if a.kind in ("null", "missing"):
        return F.lit(False)
    return F.coalesce(F.contains(fold(text(a)), fold(text(b))), F.lit(False))


def _like(x: Value, b: Value) -> Column:
    return F.coalesce(equal(x, b) | (fold(text(x)) == fold(text(b))), F.lit(False))


# Functions of one value ------------------------------------------------------------------------------------------


def parsed_number(c: Column) -> Column:
    """A price in text as a number: symbols dropped, the last separator taken as decimal unless exactly three digits follow
    a lone kind of separator."""
    t = F.regexp_replace(c, r"[^\d.,-]", "")
    dot, comma = t.contains("."), t.contains(",")
    dot_last = F.instr(F.reverse(t), ".") < F.instr(F.reverse(t), ",")
    plain = lambda x: F.replace(x, F.lit(","), F.lit(""))
    grouped = t.rlike(r"^-*\d[\d.,]*[.,]\d{3}$") & ~(dot & comma)
    lone = F.translate(t, ",", ".")
    clean = (
        F.when(dot & comma & dot_last, plain(t))
        .when(dot & comma, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", "."))
        .when(grouped, F.translate(t, ".,", ""))
        .when(dot | comma, F.when(F.length(F.regexp_replace(lone, r"[^.]", "")) <= 1, lone))
        .otherwise(t)
    )
    return F.when(t.rlike(r"\d"), clean.try_cast("double"))


def short(n: Column) -> Column:
    """1400000000 -> 1.4B, 7000000 -> 7M, 950 -> 950, 2.50 -> 2.5. The double's exact value is rounded, a tie to the even digit: 261250000 -> 261.2M."""
    out, size = None, F.abs(n)
    digits = lambda x, form: F.call_function("format_number", x.cast("double"), F.lit(form))
    for scale, suffix in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        shown = F.concat(F.regexp_replace(digits(n / scale, "0.0"), r"\.0$", ""), F.lit(suffix))
        out = F.when(size >= scale, shown) if out is None else out.when(size >= scale, shown)
    return out.when(n.isNotNull(), F.regexp_replace(F.regexp_replace(digits(n, "0.00"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, small letters after letters."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def half_even(n: Column, digits: int) -> Column:
    """Rounded half to even."""
    return F.bround(n.cast("decimal(38,12)"), digits).cast("double") if digits > 0 else F.rint(n * F.lit(10.0**digits)) / F.lit(10.0**digits)


def parse_time(v: Value) -> Column:
    """A timestamp from ISO 8601 or RFC 2822 text, or seconds, milliseconds or microseconds since 1970, also as text; else null."""
    n = number(v) if v.kind != "str" else F.when(F.trim(v.col).rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.trim(v.col).try_cast("double"))
    seconds = F.when(F.abs(n) >= 1e14, n / 1e6).when(F.abs(n) >= 1e11, n / 1e3).otherwise(n)
    unix = F.timestamp_micros((seconds * 1e6).cast("long"))
    if v.kind != "str":
        return unix
    t = F.trim(v.col)
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:?\d\d.*)?$"), t.try_cast("timestamp"))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT|Z)$", " +0000")
    mail = F.regexp_replace(F.regexp_replace(mail, r"^(\d) ", "0$1 "), r"(\d\d:\d\d:\d\d)$", "$1 +0000")
    rfc = F.when(mail.rlike(r"^\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss xx")))
    return F.coalesce(unix, iso, rfc)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def readable(c: Column) -> Column:
    """A name in capitals as people write it; small words stay small; any other name as it is."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    capitals = F.regexp_replace(c, r"[^\p{Lu}]", "")
    small = ["of", "the", "and", "for", "in", "on", "at", "to", "de", "la"]
    words = F.split(c, r"\s+")
    shown = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(small), F.lower(w)).when(~w.rlike("[AEIOUY]"), w).otherwise(F.initcap(w)))
    return F.when((F.length(letters) >= 4) & (F.length(capitals) >= 0.8 * F.length(letters)), F.array_join(shown, " ")).otherwise(c)
