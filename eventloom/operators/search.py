"""Search and ranking over catalog items: every word, rarity, sizes, typo repair, and nearest vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..functions import thai
from .joins import shared

stem = X.stem_of

#: Past forms that do not begin as the verb does.
IRREGULAR = {
    "buy": ["bought"],
    "sell": ["sold"],
    "rise": ["rose", "risen"],
    "fall": ["fell", "fallen"],
    "win": ["won"],
    "lose": ["lost"],
    "pay": ["paid"],
    "steal": ["stole"],
    "say": ["said"],
    "hold": ["held"],
    "spend": ["spent"],
    "strike": ["struck"],
    "shake": ["shook"],
}
#: What sources call a thing that is asked for under another name.
SAME = {
    "fed": ["federal reserve", "fomc"],
    "gdp": ["gross domestic product"],
    "jobless": ["unemployment"],
    "job": ["employment"],
    "inflation": ["consumer price"],
    "cpi": ["consumer price"],
    "ipo": ["go public", "initial public offering"],
    "purchase": ["bought", "buy"],
    "purchas": ["bought", "buy"],
    "sale": ["sold", "sell"],
    "warning": ["alert", "advisory", "bulletin"],
    "outage": ["issues with", "elevated error", "degraded", "disruption", "unavailable"],
    "quake": ["earthquake"],
    "sec": ["securities and exchange commission"],
    "fda": ["food and drug administration"],
    "doj": ["justice department", "department of justice"],
    "us": ["u.s.", "united states"],
    "uk": ["britain", "british", "united kingdom"],
    "eu": ["european union"],
    "un": ["united nations"],
    "ai": ["artificial intelligence"],
    "stock": ["share"],
    "flaw": ["vulnerabilit"],
    "flaws": ["vulnerabilit"],
    "bug": ["vulnerabilit"],
    "sign": ["became public law"],
    "congress": ["public law"],
    "sanction": ["designation"],
    "xai": ["x.ai"],
    "sp": ["s&p"],
    "usd": ["us dollar", "dollar"],
    "thb": ["baht"],
    "jpy": ["yen"],
    "cny": ["yuan"],
    "inr": ["rupee"],
    "eur": ["euro"],
    "tech": ["technolog"],
    "spac": ["blank check", "acquisition corp"],
}
#: Agencies by the names that registers give them. These short names match whole words only.
AGENCIES = {
    "epa": ["environmental protection agency"],
    "hhs": ["health and human services"],
    "usda": ["agriculture department", "department of agriculture"],
    "dod": ["defense department", "department of defense", "pentagon"],
    "pentagon": ["defense department", "department of defense"],
    "dhs": ["homeland security"],
    "hud": ["housing and urban development"],
    "dol": ["labor department", "department of labor"],
    "opm": ["personnel management"],
    "sba": ["small business administration"],
    "ssa": ["social security administration"],
    "cftc": ["commodity futures trading commission"],
    "nrc": ["nuclear regulatory commission"],
    "gsa": ["general services administration"],
    "fhfa": ["federal housing finance agency"],
    "cfpb": ["consumer financial protection bureau"],
    "nasa": ["national aeronautics and space administration"],
    "nlrb": ["national labor relations board"],
    "eeoc": ["equal employment opportunity commission"],
    "usaid": ["agency for international development"],
    "ftc": ["federal trade commission"],
    "fdic": ["federal deposit insurance corporation"],
    "ncua": ["national credit union administration"],
    "faa": ["federal aviation administration"],
    "irs": ["internal revenue service"],
    "osha": ["occupational safety and health administration"],
    "fcc": ["federal communications commission"],
    "fema": ["federal emergency management agency"],
    "nhtsa": ["national highway traffic safety administration"],
    "cdc": ["centers for disease control"],
    "nih": ["national institutes of health"],
}
#: Endings that a form may have, by its length; longer forms may end in anything.
SHORT_ENDS, FOUR_ENDS = "(?:s|es|'s|ed|ing)?", "(?:s|es|'s|e?d|ing|ers?|i?ans?|ese|ish)?"


OTHER, WHOLE_ONLY = SAME | AGENCIES, set(AGENCIES)


def forms(word: str) -> list[str]:
    """What a word of a question may look like in a source: the start of its own forms, irregular ones, and other names."""
    base = stem(word)
    return list(dict.fromkeys([base, *IRREGULAR.get(base, []), *OTHER.get(base, OTHER.get(word.lower(), []))]))


def _open(form: str) -> str:
    """The form as the start of a word: whole words for short names, the endings of its own forms for four letters, any end else."""
    quoted = re.sub(r"([^\w ])", r"\\\1", form)
    if len(form) <= 3 or form in WHOLE_ONLY:
        return rf"(?<!\w){quoted}{SHORT_ENDS}(?!\w)"
    if form == "hack":  # a hacker, but not the site that is named after them
        return r"(?<!\w)hack(?:s|'s|ed|ing|er(?! ?news\b)|ers)?(?!\w)"
    return rf"(?<!\w){quoted}{FOUR_ENDS}(?!\w)" if len(form) == 4 else rf"(?<!\w){quoted}"


def _all_forms(word: str) -> list[str]:
    return forms(word) if word.isascii() else [x for f in thai.forms(word) for x in (forms(f) if f.isascii() else [f])]


def pattern(word: str) -> str:
    """A question's word as a pattern for all its forms. Scripts without spaces between words match anywhere; Thai words match other spellings and
    the English words of their table too."""
    return "(?iU)" + "|".join(_open(f) if f.isascii() else re.escape(f) for f in _all_forms(word))


def has(word: str, text: Column) -> Column:
    """A plain look for the forms first, which most rows fail, then the pattern."""
    low = F.lower(text)
    some = [F.contains(low, F.lit(f)) for f in _all_forms(word if word.isascii() else word.lower())]
    return reduce(Column.__or__, some) & text.rlike(pattern(word))


def find(items: DataFrame, words: list[str], feeds: list[str] | None = None, limit: int | None = None, order: tuple[str, ...] = ("date", "key")) -> DataFrame:
    """Items that have every word in title, summary or feed name, newest first."""
    whole = F.concat_ws(" ", "title", "summary", F.replace(F.col("feed"), F.lit("-"), F.lit(" ")))
    out = items.filter(F.col("feed").isin(feeds)) if feeds else items
    for w in words:
        out = out.filter(has(w, whole))
    return out.orderBy(F.desc(order[0]), *order[1:]).limit(limit) if limit else out


def rank(items: DataFrame, words: list[str], limit: int = 20, per_story: int = 2, tie: str = "key") -> DataFrame:
    """The best items for a question: 2 for a word in the title or feed name, 1 in the summary, times 1 + ln((N + 1) / (1 + df)).

    Only items with the most words stay, and of those with at least half the best score; at most per_story updates of a
    story. One pass counts, one scores; only `limit` rows are sorted out of the whole."""
    head = F.concat_ws(" ", "title", F.replace(F.col("feed"), F.lit("-"), F.lit(" ")))
    cols = {f"h{i}": has(w, head) for i, w in enumerate(words)} | {f"b{i}": has(w, F.coalesce("summary", F.lit(""))) for i, w in enumerate(words)}
    marked = items.withColumns(cols)
    row = marked.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"h{i}") | F.col(f"b{i}")).alias(f"d{i}") for i in range(len(words))]).first()
    score, cover = F.lit(0.0), F.lit(0)
    for i in range(len(words)):
        weight = F.when(F.col(f"h{i}"), 2.0).when(F.col(f"b{i}"), 1.0).otherwise(0.0)
        score = score + weight * F.lit(1 + math.log((row["n"] + 1) / (1 + row[f"d{i}"])))
        cover = cover + (weight > 0).cast("int")
    scored = marked.withColumns({"coverage": cover, "score": F.round(score, 6)}).drop(*cols)
    best = scored.filter("coverage > 0").agg(F.max(F.struct("coverage", "score")).alias("m")).select("m.*").withColumnsRenamed({"coverage": "_c", "score": "_s"})
    kept = scored.join(F.broadcast(best)).filter((F.col("coverage") == F.col("_c")) & (F.col("score") >= F.col("_s") / 2)).drop("_c", "_s")  # one row
    kept = capped(kept, per_story, [F.desc("score"), F.desc("date"), F.asc(tie)])
    top = kept.orderBy(F.desc("score"), F.desc("date"), tie).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("date"), tie)))


def capped(items: DataFrame, per_story: int, order: list[Column]) -> DataFrame:
    """At most so many updates of each story."""
    w = Window.partitionBy(X.story(F.col("feed"), F.col("title"))).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_story).drop("_n")


def biggest(items: DataFrame, least: bool = False, limit: int = 10, tie: str = "key") -> DataFrame:
    """Items by the size that their titles state."""
    sized = items.withColumn("size", X.size(F.col("title"))).filter("size is not null")
    return sized.orderBy(F.asc("size") if least else F.desc("size"), F.desc("date"), tie).limit(limit)


def interleave(items: DataFrame, tie: str = "key") -> DataFrame:
    """Sized items by their rank within their feed, so that feeds take turns; those without size last.

    A feed is ranked in PARTS ranges of its sizes, each after the counts of those before it, so that no task sorts a whole feed."""
    cuts = items.groupBy("feed").agg(F.percentile_approx("size", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts")).withColumnRenamed("feed", "_f")
    part = F.when(F.col("size").isNull(), PARTS).otherwise(F.size(F.filter("_cuts", lambda c: c > F.col("size"))))
    parted = items.join(cuts, F.col("feed").eqNullSafe(F.col("_f"))).withColumn("_part", part).drop("_cuts", "_f")
    before = Window.partitionBy("feed").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("feed", "_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("feed").alias("_f"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy("feed", "_part").orderBy(F.col("size").desc_nulls_last(), tie)
    ranked = parted.withColumn("_k", F.row_number().over(here)).join(base, F.col("feed").eqNullSafe(F.col("_f")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("turn", (F.col("_base") + F.col("_k")).cast("int")).drop("_k", "_base", "_f", "_p", "_part")
    return ranked.orderBy(F.col("size").isNull(), "turn", F.desc("size"), tie)


#: Ranges of sizes that a feed is ranked in.
PARTS = 64


def vocabulary(items: DataFrame) -> DataFrame:
    """word, n of all words of four letters or more in titles and summaries."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    return items.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b([a-z]{4,})\b"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance: insertions, deletions, changes and swaps of neighbours; most + 1 if beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


#: Bits of the table that tells tasks which keys the asked words have: 8 MB, whatever their number; words whose keys are made at once.
BITS, AT_ONCE = 1 << 26, 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
LESS, LESS_TWO = (np.uint64(pow(int(BASE), -k, 1 << 64)) for k in (1, 2))


def _keys(words: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and hashes (some twice) of what is left of each without any letter or `most` letters, and of the word itself: equal
    strings have equal hashes. A word is a sum of letters times powers of BASE, so that what stands after a letter that goes is divided by BASE."""
    place, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    for n, at in by_size.items():
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.uint64)
        sums = np.zeros((len(at), n + 1), np.uint64)
        np.cumsum(letters * np.cumprod(np.full(n, BASE, np.uint64)), axis=1, out=sums[:, 1:])
        whole = sums[:, -1:]
        i = np.arange(n)
        found = [whole, sums[:, i] + (whole - sums[:, i + 1]) * LESS]
        if most == 2:
            i, j = np.triu_indices(n, 1)
            found.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * LESS + (whole - sums[:, j + 1]) * LESS_TWO)
        found = np.concatenate(found, axis=1)
        place.append(np.repeat(np.array(at, np.int64), found.shape[1]))
        keys.append(found.ravel())
    return np.concatenate(place), np.concatenate(keys)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys ^ (keys >> np.uint64(29))) * BASE >> np.uint64(64 - (BITS.bit_length() - 1))


def _keyed(rows: DataFrame, rest: str, table=None) -> DataFrame:
    """key, w and the other columns (named in `rest`) of rows of w, most and these: one for each key; with a table, for the keys it has alone."""
    others = [x.split()[0] for x in rest.split(", ")]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                for most in (1, 2):
                    some = part.filter(pc.equal(part.column(1), most))
                    at, keys = _keys(some.column(0).to_pylist(), most)
                    if table is not None:
                        slots = _slots(keys)
                        has = (table.value[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
                        at, keys = at[has], keys[has]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[some.column(c).take(pa.array(at)) for c in ["w", *others]]], names=["key", "w", *others])

    return rows.select("w", F.col("most").cast("int"), *[c for c in others if c != "most"]).mapInArrow(run, f"key long, w string, {rest}")


def _table(keyed: DataFrame):
    """Which keys there are, as bits that are sent to all tasks: a table of fixed size."""

    def run(batches):
        bits = np.zeros(BITS >> 6, np.uint64)
        for b in batches:
            slots = _slots(b.column(0).to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    got = keyed.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return keyed.sparkSession.sparkContext.broadcast(bits)


def repair(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, fixed: the most frequent vocabulary word within one edit (two from nine letters), for words of five letters or
    more that the vocabulary lacks. Words within so many edits are equal without so many letters each: they meet by a hash of what is left, and
    all that meet are compared. Of the vocabulary's hashes only those that a table of the asked words' may hold are shuffled."""
    vocab = shared(vocab)
    unknown = words.filter(F.col("word").rlike("^[a-z]{5,}$")).join(vocab.select("word"), "word", "left_anti").distinct()
    asked = shared(_keyed(unknown.select(F.col("word").alias("w"), F.when(F.length("word") >= 9, 2).otherwise(1).alias("most")), "most int"))
    known = vocab.filter(F.length("word") >= 4).select(F.col("word").alias("w"), F.col("n").cast("long"), F.when(F.length("word") >= 7, 2).otherwise(1).alias("most"))
    known = _keyed(known, "n long", _table(asked)).withColumnRenamed("w", "v")
    near = known.join(asked.withColumnRenamed("w", "word"), "key").select("word", "v", "n", "most").distinct()

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y, m) for x, y, m in zip(a, b, most, strict=True)], dtype="int32")

    close = near.filter(distance("word", "v", "most") <= F.col("most"))
    return close.groupBy("word").agg(F.max(F.struct("n", "v")).alias("b")).select("word", F.col("b.v").alias("fixed"))


#: Queries that are sent to all tasks at once, cells of a block of similarities (it should stay in a core's cache), vectors that go
#: through all queries together at least, and how many similarities are made again at once.
BLOCK, CELLS, TOGETHER, ENTRIES = 1 << 16, 1 << 20, 256, 1 << 14
#: Tasks that vectors are dealt to at most, and for each core: each begins its lists anew, k a query, and sends all of them.
TASKS, TASKS_A_CORE = 64, 3


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one as a matrix, and which rows of the column they are: those without nulls, of the most common number of
    components, and with a length."""
    rows = [None if x is None or None in x else x for x in lists.to_pylist()]
    sizes = Counter(len(x) for x in rows if x)
    dims = sizes.most_common(1)[0][0] if sizes else 0
    at = np.array([i for i, x in enumerate(rows) if x and len(x) == dims], np.int64)
    m = np.array([rows[i] for i in at], np.float64).reshape(len(at), dims)
    norm = np.sqrt((m * m).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return m[good] / norm[good, None], at[good]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """query_id, vec_id, label, similarity, rank by cosine, equal ones by the smaller vec_id; a vector is no neighbour of its own id.

    Queries are a stated set; they are sent to all tasks in blocks of about BLOCK. A task multiplies its vectors, some at a time, with a block's
    matrix and keeps k a query, looking only at similarities that can be among them; these lists alone are shuffled. Vectors that are null, hold a null, are all zeros or have another number of
    components than the queries take no part."""
    tasks = max(TASKS, TASKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label").coalesce(tasks)
    asked = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    blocks = -(-asked.count() // BLOCK) or 1
    label = rows.schema["label"].dataType.simpleString()
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")

    def ranked(i: int) -> DataFrame:
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else asked
        got = block.toArrow().combine_chunks()
        matrix, at = _unit(got["embedding"].combine_chunks()) if got.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))
        sent = vectors.sparkSession.sparkContext.broadcast((matrix, got["vec_id"].to_numpy()[at] if len(at) else np.zeros(0, np.int64)))

        def run(batches):
            q, ids = sent.value
            top = _Best(q, ids, k, least)
            for b in batches if len(q) else ():
                v, at = _unit(b.column(1))
                if v.shape[1] == q.shape[1]:
                    own, names = b.column(0).to_numpy(zero_copy_only=False)[at], np.array(b.column(2).to_pylist(), object)[at]
                    for lo in range(0, len(v), step := max(TOGETHER, CELLS // len(q))):
                        top.add(v[lo : lo + step], own[lo : lo + step], names[lo : lo + step])
            at, near, sims, names = top.rows()
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near), pa.array(names.tolist(), schema[2].type), pa.array(sims)], schema=schema)

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("label", to_arrow_type(rows.schema["label"].dataType)), ("similarity", pa.float64())])
        part = rows.mapInArrow(run, f"query_id long, vec_id long, label {label}, similarity double")
        return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [ranked(i) for i in range(blocks)])


class _Best:
    """The k best of each query among the vectors so far, by rounded similarity, equal ones by the smaller id.

    Of a block of similarities, made in single precision, only those are looked at that can come before a query's k-th one, which grows;
    they are made again in double precision and wait until there are many, so that the lists are sorted seldom."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int, least: float | None):
        self.q, self.ids, self.k, self.single = q, ids, k, q.astype(np.float32)
        # What rounding to six places adds at most, and what single precision is off for vectors of length one.
        self.off = 1e-6 + (q.shape[1] + 8) * 2.0**-22
        self.bound, self.last = np.full(len(ids), -np.inf if least is None else least), np.full(len(ids), np.iinfo(np.int64).max)
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))
        self.wait, self.waiting = [], 0
        self.room = np.zeros(0, np.float32)

    def add(self, v: np.ndarray, own: np.ndarray, names: np.ndarray) -> None:
        single, step = v.astype(np.float32).T, max(1, CELLS // max(1, len(v)))
        for lo in range(0, len(self.q), step):
            self._add(slice(lo, lo + step), v, single, own, names)
        if self.waiting > len(self.held[0]) // 2:
            self._sort()

    def _add(self, some: slice, v: np.ndarray, single: np.ndarray, own: np.ndarray, names: np.ndarray) -> None:
        """Some queries and the vectors."""
        q, ids, bound, last = self.q[some], self.ids[some], self.bound[some], self.last[some]
        n = len(q) * len(v)
        if n > len(self.room):
            self.room = np.empty(n, np.float32)
        about = self.room[:n].reshape(len(q), len(v))
        np.matmul(self.single[some], single, out=about)
        hits = np.flatnonzero(about >= (bound - self.off).astype(np.float32)[:, None])
        if 16 * len(hits) > n:  # few vectors yet, or many copies: of equal ones only a smaller id than the k-th one's
            sims = np.round(q @ v.T, 6)
            sims[ids[:, None] == own] = -np.inf
            kth = np.partition(sims, len(v) - self.k, axis=1)[:, len(v) - self.k, None] if len(v) > self.k else -np.inf
            at, col = np.nonzero((sims >= kth) & ((sims > bound[:, None]) | ((sims == bound[:, None]) & (own < last[:, None]))))
            found = sims[at, col]
        else:
            at, col = np.divmod(hits, len(v))
            parts = [slice(lo, lo + ENTRIES) for lo in range(0, len(at), ENTRIES)]
            found = np.round(np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[at[p]], v[col[p]]) for p in parts]]), 6)
        keep = ((found > bound[at]) | ((found == bound[at]) & (own[col] < last[at]))) & (own[col] != ids[at])
        at, col, found = at[keep], col[keep], found[keep]
        if len(at):
            self.wait.append((at + some.start, own[col], found, names[col]))
            self.waiting += len(at)

    def _sort(self) -> None:
        at, own, sims, names = (np.concatenate(x) for x in zip(self.held, *self.wait, strict=True))
        order = np.lexsort((own, -sims, at))
        first = np.searchsorted(at[order], np.arange(len(self.ids)))
        nth = np.arange(len(order)) - first[at[order]]
        last = order[nth == self.k - 1]
        self.bound[at[last]], self.last[at[last]] = sims[last], own[last]
        order = order[nth < self.k]
        self.held, self.wait, self.waiting = (at[order], own[order], sims[order], names[order]), [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query (its place), id, similarity and label of each one held."""
        if self.wait:
            self._sort()
        return self.held


def vote(near: DataFrame) -> DataFrame:
    """query_id, label, votes: the label that most neighbours have, ties to the smaller."""
    return near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes")).groupBy("query_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("b")).select("query_id", F.col("b.label").alias("label"), (-F.col("b.v")).alias("votes"))
