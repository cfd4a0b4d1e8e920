"""Dotted paths over typed columns: a.b.0.c, with negative list places; absent is not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Value, value_of



def missing() -> Value:
    return Value("missing", F.lit(None).cast("string"))


class Scope:
    """Finds a path in a DataFrame's columns: data.* as written, then inside `data`, then any column."""

    def __init__(self, df: DataFrame, extra: dict[str, Value] | None = None):
        self.schema, self.extra = df.schema, extra or {}

    def find(self, path: str) -> Value:
        if path in self.extra:
            return self.extra[path]
        if path in self.schema.names:
            return value_of(F.col(f"`{path}`"), self.schema[path].dataType)
        parts = path.split(".")
        if parts[0] != "data" and "data" in self.schema.names:
            got = self._walk(F.col("data"), self.schema["data"].dataType, parts)
            if got.kind != "missing":
                return got
        if parts[0] in self.schema.names:
            return self._walk(F.col(f"`{parts[0]}`"), self.schema[parts[0]].dataType, parts[1:])
        return missing()

    def _walk(self, col: Column, t: T.DataType, parts: list[str]) -> Value:
        for i, part in enumerate(parts):
            if isinstance(t, T.StructType) and part in t.names:
                col, t = col.getField(part), t[part].dataType
            elif isinstance(t, T.MapType):
                col, t = F.try_element_at(col, F.lit(part)), t.valueType
            elif isinstance(t, T.ArrayType) and part.lstrip("-").isdigit():
                n = int(part)
                col, t = F.try_element_at(col, F.lit(n + 1 if n >= 0 else n)), t.elementType
            elif isinstance(t, T.VariantType):
                return Value("str", F.try_variant_get(col, json_path(parts[i:]), "string"))
            elif isinstance(t, T.StringType) and i:
                return missing()
            else:
                return missing()
        return value_of(col, t)

    def present(self, path: str) -> Column:
        """Whether the path is there at all, even if null."""
        parts = path.split(".")
        v = self.find(path)
        if v.kind == "missing":
            return F.lit(False)
        head = "data" if parts[0] != "data" and "data" in self.schema.names and not (path in self.schema.names) else parts[0]
        if head in self.schema.names and isinstance(self.schema[head].dataType, T.VariantType):
            return F.try_variant_get(F.col(head), json_path(parts[1:] if head == parts[0] else parts), "variant").isNotNull()
        return F.lit(True)


def json_path(parts: list[str]) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f'["{p}"]' for p in parts)


def flatten(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Dotted names and columns of all leaves; lists become JSON text."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        col = F.col(".".join(f"`{p}`" for p in name.split(".")))
        if isinstance(f.dataType, T.StructType):
            out += flatten(f.dataType, name + ".")
        else:
            out.append((name, F.to_json(col) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.VariantType)) else col))
    return out


def strings(col: Column, t: T.DataType) -> list[Column]:
    """Every text inside a value, as arrays of strings."""
    if isinstance(t, T.StringType):
        return [F.array(col)]
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return [col]
    if isinstance(t, T.ArrayType):
        inner = lambda x: F.flatten(F.array(*strings(x, t.elementType))) if strings(x, t.elementType) else F.array().cast("array<string>")
        return [F.flatten(F.transform(col, inner))]
    if isinstance(t, T.StructType):
        return [s for f in t.fields for s in strings(col.getField(f.name), f.dataType)]
    return []
