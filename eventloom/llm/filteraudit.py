"""Filter interaction audit: packed bitmaps of filters and labels, partition by partition, counted for each set of filters applied before."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import BROADCAST_BYTES, sided, stored

MARKS = np.isin(np.arange(256), list(b"#$%&*|"))
HEAD = (np.arange(256) & 0xC0) != 0x80
CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
#: Parts whose counts a task holds before it sends them on.
PARTS = 4096
#: A class of equal texts is heavy with over one of so many rows; so there are fewer than that many of them.
HEAVY = 1 << 14


# The five filters ---------------------------------------------------------------------------------------------------


def fails(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each text, whether it fails A (under 200 words), B (under half of its words distinct), C (over 2 % of its code points A-Z)
    and D (holds one of #$%&*|). Words are told apart by their bytes."""
    w, bounds = tk.words(data, offs, lower=False)
    n, row = np.diff(bounds), np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    code = tk.codes(w)
    base = int(code.max(initial=0)) + 1
    distinct = np.bincount(np.unique(row * base + code) // base, minlength=len(n)) if len(code) else np.zeros(len(n), np.int64)
    points, capital = tk.per_row(HEAD[data], offs), tk.per_row(CAPITAL[data], offs)
    return [n < 200, 100 * distinct < 50 * n, 100 * capital > 2 * points, tk.per_row(MARKS[data], offs) > 0]


def own_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, what A to D say of the whole text, and its 128-bit hash (h1, h2). Null texts and parts are empty ones."""

    def run(batches):
        for b in batches:
            data, offs = tk.flat(b.column(2))
            got = [fails(d, o) for _, _, d, o in tk.slices(data, offs)]
            marks = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, bool)] * 4
            view = memoryview(np.ascontiguousarray(data))
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, marks), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "part", *"ABCD", "h1", "h2"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, h1 long, h2 long")


def with_copies(marks: DataFrame, heavy: int = HEAVY, most: int = BROADCAST_BYTES) -> DataFrame:
    """marks with E: whether a row with a smaller doc_id has the same text. A null id is smaller than none and none is smaller than it.

    Classes of equal texts that hold two ids are joined by broadcast if they fit in `most` bytes. If not, only the heavy ones (more than one row
    of `heavy`, so fewer than that many) are, and the others, none of which is large, by shuffle."""
    text = ["h1", "h2"]
    whole = marks.groupBy(*text).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    classes = stored(whole.filter(F.col("last") > F.col("first")).select(*text, "first", "n"), "copies")
    e = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows, side = marks.count(), sided(classes.drop("n"), 40, most)
    if classes.limit(most // 40 + 1).count() <= most // 40:
        return marks.join(side, text, "left").withColumn("E", e).drop(*text, "first")
    big = classes.filter(F.col("n") * heavy > rows).drop("n")
    seen = marks.join(F.broadcast(big), text, "left")
    rest = seen.filter("first is null").drop("first").join(classes.filter(F.col("n") * heavy <= rows).drop("n"), text, "left")
    return seen.filter("first is not null").unionByName(rest).withColumn("E", e).drop(*text, "first")


def standard_marks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, A to E (true: fails), good and toxic of each row of docs; several labels of an id count if one of them says so."""
    marks = with_copies(stored(own_marks(docs, id_col, text_col, part_col), "marks"))
    yes = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null and (good or toxic)")
    return marks.join(sided(stored(yes, "labels"), 24), "doc_id", "left").drop("doc_id")


# Bitmaps ------------------------------------------------------------------------------------------------------------


class Bitmap:
    """Bits of some rows, laid out so that each part begins at a new 64-bit word: a part is a run of words, and one pass counts all parts."""

    def __init__(self, part: np.ndarray, parts: int):
        counts = np.bincount(part, minlength=parts)
        words = -(-counts // 64)
        self.starts = np.concatenate(([0], np.cumsum(words)))
        order = np.argsort(part, kind="stable")
        at = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[:-1] * 64, counts)
        self.at = np.empty(len(part), np.int64)
        self.at[order] = at
        self.rows = self.pack(np.ones(len(part), bool))

    def pack(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(self.starts[-1]) * 64, bool)
        bits[self.at] = flags
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def counts(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part (each has a row, so no run is empty)."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts[:-1]) if len(bits) else np.zeros(0, np.int64)


def survivors(part: np.ndarray, parts: int, filters: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """[part, set, 1 + labels]: rows of a part that fail none of the filters of a set (bit i: filter i), and those of them with each label."""
    bitmap = Bitmap(part, parts)
    failing, having = [bitmap.pack(f) for f in filters], [bitmap.rows, *[bitmap.pack(x) for x in labels]]
    out = np.zeros((parts, 1 << len(filters), len(having)), np.int64)
    left = [bitmap.rows]
    for s in range(1 << len(filters)):
        if s:  # the set without its highest filter has been met: one AND-NOT more
            top = s.bit_length() - 1
            left.append(left[s ^ 1 << top] & ~failing[top])
        for j, x in enumerate(having):
            out[:, s, j] = bitmap.counts(left[s] & x)
    return out


def prefix_counts(marks: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """part, filters (bits of the set), kept and one count for each label: sums of what each partition's bitmaps count."""
    names = ["part", "filters", "kept", *labels]

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            at = np.stack(list(held.values()))
            sets = at.shape[1]
            cols = [pa.array(np.repeat(np.array(list(held), object), sets), pa.string()), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(held)))]
            rows = pa.RecordBatch.from_arrays([*cols, *[pa.array(at[:, :, j].ravel()) for j in range(at.shape[2])]], names=names)
            held.clear()
            return rows

        for b in batches:
            for lo in range(0, b.num_rows, 1 << 16):
                piece = b.slice(lo, 1 << 16)
                coded = pc.fill_null(piece.column(0), "").dictionary_encode()
                flags = [pc.fill_null(c, False).to_numpy(zero_copy_only=False) for c in piece.columns[1:]]
                got = survivors(coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary), flags[: len(filters)], flags[len(filters) :])
                for name, n in zip(coded.dictionary.to_pylist(), got, strict=True):
                    held[name] = held[name] + n if name in held else n
                if len(held) > PARTS:
                    yield out()
        if held:
            yield out()

    rows = marks.select(F.col(f"`{part}`").cast("string"), *[F.col(f"`{c}`").cast("boolean") for c in [*filters, *labels]])
    counted = rows.mapInArrow(run, ", ".join(["part string", "filters int", *[f"{c} long" for c in names[2:]]]))
    return counted.groupBy("part", "filters").agg(*[F.sum(c).alias(c) for c in names[2:]])


def audit(marks: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, one `lost` count for each label, and shapley.

    marks has a row for each document: its part (null is the empty one), a boolean for each filter (true: fails; null: passes) and label.
    Rows are packed where they lie; a partition sends on no more than 2 ** len(filters) rows for each part that it met. Of at most six filters
    (720 orders) all orders are returned; names of filters are joined to that of the order. An empty table gives no rows."""
    if len(filters) > 6:
        raise ValueError("at most six filters: all orders of more are too many rows")
    full = (1 << len(filters)) - 1
    counts = F.map_from_entries(F.collect_list(F.struct("filters", F.struct("kept", *labels))))
    parts = prefix_counts(marks, filters, labels, part).groupBy("part").agg(counts.alias("n"))  # 2 ** len(filters) entries each
    kept = lambda s, c="kept": F.col("n")[s if not isinstance(s, int) else F.lit(s)][c]

    def shapley(i: int):
        """removed by filter i after each set of others, times the orders in which just that set is before it."""
        total = F.lit(0).cast("long")
        for s in range(full + 1):
            if not s >> i & 1:
                k = s.bit_count()
                total = total + F.lit(factorial(k) * factorial(len(filters) - 1 - k)) * (kept(s) - kept(s | 1 << i))
        return total

    parts = parts.withColumn("shapley", F.array(*[shapley(i) for i in range(len(filters))]))
    parts = parts.withColumn("fails", F.array(*[kept(0) - kept(1 << i) for i in range(len(filters))]))
    parts = parts.withColumn("unique", F.array(*[kept(full & ~(1 << i)) - kept(full) for i in range(len(filters))]))
    steps = [(order, k) for order in permutations(range(len(filters))) for k in range(len(filters))]
    rows = [{"filter_order": "".join(filters[i] for i in o), "step": k + 1, "f": o[k], "before": sum(1 << i for i in o[:k]), "after": sum(1 << i for i in o[: k + 1])} for o, k in steps]
    constant = F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>")
    s = parts.withColumn("s", F.explode(constant)).select("*", "s.*")
    removed = kept(F.col("before")) - kept(F.col("after"))
    lost = [(kept(F.col("before"), c) - kept(F.col("after"), c)).alias(f"{c}_lost") for c in labels]
    at = lambda c: F.get(c, F.col("f"))
    return s.select("part", "filter_order", "step", kept(F.col("after")).alias("kept"), removed.alias("removed"), (at("fails") - removed).alias("redundant"), at("unique").alias("unique_fails"), *lost, at("shapley").alias("shapley"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM d JOIN c USING (t) LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY ALL),
bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS o UNION ALL SELECT o || f FROM o, bits WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, step, bit, (SELECT coalesce(sum(b.bit), 0) FROM bits b WHERE contains(substr(o, 1, step - 1), b.f))::INTEGER AS before
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM o WHERE length(o) = 5) JOIN bits ON bits.f = substr(o, step, 1)),
r AS (SELECT part, filter_order, step::INTEGER AS step, bit, coalesce(sum(n) FILTER (x & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (x & before = 0 AND x & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (x & before > 0 AND x & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (x = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (x & before = 0 AND x & bit > 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (x & before = 0 AND x & bit > 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM f, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
