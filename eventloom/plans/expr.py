"""A small safe expression language, compiled to Spark columns.

    or := and ((or | "||") and)*     and := not ((and | &&) not)*     not := (not | !) not | comparison
    comparison := sum [operator sum]     sum := product ((+ | -) product)*     product := value ((* | /) value)*
    value := - value | number | text | path | `path` | function(or, ...) | (or) | [value, ...]
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.paths import Scope
from ..functions.values import Value


class ExpressionError(ValueError):
    """Says what is wrong, and points at where."""

    def __init__(self, message: str, source: str = "", at: int = 0):
        super().__init__(f"{message}\n  {source}\n  {' ' * at}^" if source else message)


#: The signs and words of the language.
SIGNS = ("==", "!=", "<=", ">=", "&&", "||", "<", ">", "=", "!", "+", "-", "*", "/", "(", ")", "[", "]", ",")
COMPARE = {"==", "=", "!=", "<", "<=", ">", ">=", "contains", "in", "startswith", "endswith", "matches"}
KEYWORDS = {"and", "or", "not", "true", "false", "null", "contains", "in", "startswith", "endswith", "matches"}


def _run(source: str, at: int, more: str = "") -> int:
    """The end of the letters, digits, underscores and `more` from at on."""
    while at < len(source) and (source[at].isalnum() or source[at] in "_" + more):
        at += 1
    return at


def _closed(source: str, at: int) -> int:
    """The end of the text that begins with a quote at `at`; a backslash takes the next character as it is. 0 if it has no end."""
    end = at + 1
    while end < len(source) and source[end] != source[at]:
        end += 2 if source[end] == "\\" else 1
    return end + 1 if end < len(source) else 0


def _token(source: str, at: int) -> tuple[str, str, int, int]:
    """Kind, body, start of the body, and end of the token at a place that is no space."""
    c, end = source[at], 0
    if c in "'\"":
        if end := _closed(source, at):
            return "text", source[at:end], at, end
    elif c == "`":
        if (end := source.find("`", at + 1)) > at + 1:
            return "quoted", source[at + 1 : end], at + 1, end + 1
    elif c.isdecimal():
        end = at + len(source[at:]) - len(source[at:].lstrip("0123456789"))
        if source[end : end + 1] == "." and source[end + 1 : end + 2].isdecimal():
            end += 1 + len(source[end + 1 :]) - len(source[end + 1 :].lstrip("0123456789"))
        if _run(source, end) == end:
            return "number", source[at:end], at, end
    elif c.isalpha() or c == "_":
        end = _run(source, at, ":$@-")
        while source[end : end + 1] == "." and _run(source, end + 1, ":$@-") > end + 1:
            end = _run(source, end + 1, ":$@-")
        word = source[at:end]
        return ("key", word.lower(), at, end) if word.lower() in KEYWORDS else ("word", word, at, end)
    elif sign := next((x for x in SIGNS if source.startswith(x, at)), None):
        return "op", sign, at, at + len(sign)
    raise ExpressionError("unexpected character", source, at)


def tokens(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(source):
        if source[at].isspace():
            at += 1
            continue
        kind, body, start, at = _token(source, at)
        out.append((kind, body, start))
    return [*out, ("end", "", len(source))]


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.i = source, tokens(source), 0

    def fail(self, message: str):
        raise ExpressionError(message, self.source, self.tokens[self.i][2])

    def take(self, *wanted: str) -> str | None:
        kind, body, _ = self.tokens[self.i]
        if kind in ("op", "key") and body in wanted:
            self.i += 1
            return body
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            self.fail(f"expected {wanted!r}")

    def parse(self):
        tree = self.either()
        if self.tokens[self.i][0] != "end":
            self.fail("unexpected text after the expression")
        return tree

    def _chain(self, part, *ops: str):
        tree = part()
        while op := self.take(*ops):
            tree = (op, tree, part())
        return tree

    def either(self):
        return self._chain(self.both, "or", "||")

    def both(self):
        return self._chain(self.negated, "and", "&&")

    def negated(self):
        if self.take("not", "!"):
            return ("not", self.negated())
        left = self.sum()
        if op := self.take(*COMPARE):
            return (op, left, self.sum())
        return left

    def sum(self):
        return self._chain(self.product, "+", "-")

    def product(self):
        return self._chain(self.value, "*", "/")

    def value(self):
        if self.take("-"):
            return ("negative", self.value())
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.take("["):
            return ("list", self._listed("]"))
        kind, body, at = self.tokens[self.i]
        self.i += 1
        if kind == "number":
            return ("number", float(body) if "." in body else int(body))
        if kind == "text":
            return ("text", re.sub(r"\\(.)", r"\1", body[1:-1]))
        if kind == "quoted":
            return ("path", body)
        if kind == "key" and body in ("true", "false", "null"):
            return ("literal", {"true": True, "false": False, "null": None}[body])
        if kind == "word":
            if self.take("("):
                args = self._listed(")")
                low, high = FUNCTIONS.get(body.lower(), (None, 0, 0))[1:]
                if body.lower() not in FUNCTIONS:
                    raise ExpressionError(f"unknown function {body}()", self.source, at)
                if not low <= len(args) <= high:
                    raise ExpressionError(f"{body}() takes {low}{f' to {high}' if high > low else ''} arguments", self.source, at)
                return ("call", body.lower(), args)
            return ("path", body)
        self.i -= 1
        self.fail("expected a value")

    def _listed(self, end: str) -> list:
        out = []
        if self.take(end):
            return out
        while True:
            out.append(self.either())
            if self.take(end):
                return out
            self.need(",")


def _java(pattern: str) -> str:
    """A Python pattern in Java's dialect."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ExpressionError(f"invalid regular expression {pattern!r}: {e}") from None
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern).replace(r"\Z", r"\z")


def _one(f, kind="str"):
    """A function of text that leaves other values alone."""
    return lambda scope, v: Value(kind, f(v.col)) if v.kind == "str" else v


def _length(scope, v):
    if v.kind in ("list", "obj"):
        return Value("int", F.coalesce(F.size(v.col) if v.kind == "list" else F.size(F.map_keys(F.from_json(F.to_json(v.col), "map<string,string>"))), F.lit(0)))
    return Value("int", F.coalesce(F.char_length(v.col), F.lit(0)) if v.kind == "str" else F.lit(0))


def _constant(tree, what: str):
    if tree[0] == "negative":
        return -_constant(tree[1], what)
    if tree[0] not in ("number", "text"):
        raise ExpressionError(f"{what} must be a constant")
    return tree[1]


def _rounded(scope, v, digits=("number", 0)):
    n = int(_constant(digits, "the number of digits"))
    got = V.half_even(V.number(v), n)
    return Value("num", got) if n > 0 else Value("int", got.cast("long"))


def _commas(scope, v, digits=("number", 0)):
    return Value("str", F.format_number(V.number(v), max(0, int(_constant(digits, "the number of digits")))))


def _replaced(scope, v, pattern, new):
    if v.kind != "str":
        return v
    return Value("str", F.regexp_replace(v.col, F.lit(_java(_constant(pattern, "the pattern"))), F.lit(re.sub(r"\\(\d)", r"$\1", _constant(new, "the new text")))))


def _default(scope, v, other):
    if v.kind in ("null", "missing"):
        return other
    kind = v.kind if v.kind == other.kind else "num" if {v.kind, other.kind} == {"num", "int"} else "str"
    a, b = (v.col, other.col) if kind != "str" else (V.text(v), V.text(other))
    empty = V.text(v) == "" if v.kind == "str" else F.lit(False)
    return Value(kind, F.when(v.col.isNull() | empty, b).otherwise(a), v.item)


def _extreme(f):
    def run(scope, *vs):
        n = [V.number(v) for v in vs]
        return Value("num", f(*n) if len(n) > 1 else n[0])

    return run


def _number(scope, v):
    return v if v.kind in ("num", "int") else Value("num", V.parsed_number(v.col) if v.kind == "str" else F.lit(None).cast("double"))


#: name -> (function, least and most arguments); arguments named by RAW are passed as trees.
FUNCTIONS = {
    "lower": (_one(F.lower), 1, 1), "upper": (_one(F.upper), 1, 1), "trim": (_one(V.strip), 1, 1), "title": (_one(V.title_case), 1, 1),
    "len": (_length, 1, 1), "number": (_number, 1, 1), "round": (_rounded, 1, 2), "abs": (lambda s, v: Value("num", F.abs(V.number(v))), 1, 1),
    "short": (lambda s, v: Value("str", V.short(V.number(v))), 1, 1), "commas": (_commas, 1, 2), "exists": (None, 1, 1), "default": (_default, 2, 2),
    "max": (_extreme(F.greatest), 1, 20), "min": (_extreme(F.least), 1, 20), "replace": (_replaced, 3, 3),
    "date": (lambda s, v: Value("str", V.iso(V.parse_time(v))), 1, 1), "readable": (_one(V.readable), 1, 1),
}
RAW = {"round": {1}, "commas": {1}, "replace": {1, 2}}


def evaluate(tree, scope: Scope) -> Value:
    op = tree[0]
    if op == "number":
        return Value("int" if isinstance(tree[1], int) else "num", F.lit(tree[1]).cast("long" if isinstance(tree[1], int) else "double"))
    if op == "text":
        return Value("str", F.lit(tree[1]))
    if op == "literal":
        return V.null() if tree[1] is None else Value("bool", F.lit(tree[1]))
    if op == "path":
        return scope.find(tree[1])
    if op == "list":
        vs = [evaluate(x, scope) for x in tree[1]]
        nums = bool(vs) and all(v.kind in ("num", "int") for v in vs)
        return Value("list", F.array(*[v.col.cast("double") if nums else V.text(v) for v in vs]), "num" if nums else "str")
    if op == "call":
        name, args = tree[1], tree[2]
        if name == "exists":
            if args[0][0] != "path":
                raise ExpressionError("exists() takes a path")
            return Value("bool", scope.present(args[0][1]))
        return FUNCTIONS[name][0](scope, *[a if i in RAW.get(name, ()) else evaluate(a, scope) for i, a in enumerate(args)])
    if op == "not":
        return Value("bool", ~V.truthy(evaluate(tree[1], scope)))
    if op == "negative":
        v = evaluate(tree[1], scope)
        return Value("int", -v.col) if v.kind == "int" else Value("num", -V.number(v))
    a = evaluate(tree[1], scope)
    if op == "matches":
        pattern = _java(_constant(tree[2], "the pattern"))
        return Value("bool", F.coalesce(V.text(a).rlike(pattern), F.lit(False)))
    b = evaluate(tree[2], scope)
    if op in ("or", "||"):
        return Value("bool", V.truthy(a) | V.truthy(b))
    if op in ("and", "&&"):
        return Value("bool", V.truthy(a) & V.truthy(b))
    if op in ("==", "="):
        return Value("bool", V.equal(a, b))
    if op == "!=":
        return Value("bool", ~V.equal(a, b))
    if op in ("<", "<=", ">", ">="):
        return Value("bool", V.ordered(op, a, b))
    if op == "contains":
        return Value("bool", V.holds(a, b))
    if op == "in":
        return Value("bool", V.holds(b, a))
    if op in ("startswith", "endswith"):
        return Value("bool", F.coalesce(getattr(F, op)(V.fold(V.text(a)), V.fold(V.text(b))), F.lit(False)))
    if op == "+":
        if a.kind == b.kind == "int":
            return Value("int", a.col + b.col)
        if a.kind in ("num", "int") and b.kind in ("num", "int"):
            return Value("num", V.number(a) + V.number(b))
        joined = F.concat(V.text(a), V.text(b))
        if a.kind == b.kind == "str":
            return Value("str", joined)
        if {a.kind, b.kind} & {"num", "int"}:  # numeric text with a number adds, other text joins
            n = V.number(a) + V.number(b)
            return Value("str", F.when(n.isNotNull(), F.regexp_replace(n.cast("string"), r"\.0$", "")).otherwise(joined))
        return Value("str", joined)
    if op == "-" and a.kind == b.kind == "int":
        return Value("int", a.col - b.col)
    if op == "*" and a.kind == b.kind == "int":
        return Value("int", a.col * b.col)
    x, y = V.number(a), V.number(b)
    return Value("num", {"-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]())


def compile_value(source: str, df: DataFrame, extra: dict[str, Value] | None = None) -> Value:
    return evaluate(Parser(source).parse(), Scope(df, extra))


def compile_filter(source: str, df: DataFrame) -> Column:
    return V.truthy(compile_value(source, df))


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts)
