"""Exact n-gram Jaccard join.

Who meets whom: a set can only link if at least so many of its tokens stand in other sets too, that is if at most n - least stand
alone. First, tokens with some hashes, a part twice as large as what a set may lack, are counted: sets with more than n - least
lone tokens among these are out, which are nearly all that are not copies. The tokens of the others are counted whole, and ordered in
each set from the rarest to the most frequent. Sets that link share one of their first n - least + 1 tokens; lone ones cannot be
that one. Sets of near sizes that share a token of their prefixes are put in one group. A group's sets meet in one task, or, above a fixed weight, in one task for each two
of its blocks. There the join is by set relations: an index of prefix tokens in blocks of one position, skipped whole when the
position leaves no room for the overlap, finds out if a set can have answers; its overlaps are added up over the index; and the
overlaps of every set similar to it are derived from those by the few tokens in which the two differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .links import components
from .runtime import discard, sided, stored, tidy

#: Shingles that meet in one task at most, but for two blocks of half of it each.
WEIGHT = 2 << 20
#: Tokens of one partition; one set in SAMPLE, by its text, tells which tokens stand in HOT sets or more.
PART, SAMPLE, HOT = 1 << 20, 64, 200_000


def least_overlap(s, percent: int):
    """The least intersection of two linked sets whose sizes add up to s."""
    return -(-percent * s // (100 + percent))


def fingerprints(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set, as two numbers."""
    out = np.empty((len(offs) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            ends = np.cumsum(np.concatenate((np.zeros(1, np.uint64), tk.mix(s ^ np.uint64(salt)))))
            out[:, i] = tk.mix(ends[offs[1:]] - ends[offs[:-1]] + np.diff(offs).astype(np.uint64))
    return out


def _nodes(marks: np.ndarray) -> pa.Array:
    return tk.binary(marks.view(np.uint8).ravel(), 16 * np.arange(len(marks) + 1)).cast(pa.binary())


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = tk.flat(column)
    for lo, hi, d, o in tk.slices(data, offs):
        w, bounds = tk.words(d, o)
        yield lo, hi, *tk.distinct_sets(*tk.shingles(tk.hashes(w), bounds, words))


class Index:
    """Inverted lists over a group's sets, and prefix lists in blocks of one position."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(x) for x in sets])
        _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        who = np.repeat(np.arange(len(sets)), self.n)
        order = np.lexsort((rank[code], who))
        self.tokens, self.starts = rank[code][order], np.concatenate(([0], np.cumsum(self.n)))
        by = np.argsort(self.tokens, kind="stable")
        self.lists, self.list_at = who[by], np.searchsorted(self.tokens[by], np.arange(len(df) + 1))
        # Prefixes: one of the first n - least + 1 tokens is shared with any linked set.
        place = np.arange(len(who)) - self.starts[who]
        need = -(-percent * self.n // 100)
        inner = place <= (self.n - need)[who]
        t, p, w = self.tokens[inner], place[inner], who[inner]
        o = np.lexsort((w, p, t))
        t, p, self.entry = t[o], p[o], w[o]
        first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])))) if len(t) else np.zeros(0, np.int64)
        self.block, self.block_place = np.append(first, len(t)), p[first]
        sizes = self.n[self.entry]
        self.block_least, self.block_most = (np.minimum.reduceat(sizes, first), np.maximum.reduceat(sizes, first)) if len(first) else (first, first)
        self.block_at = np.searchsorted(t[first], np.arange(len(df) + 1))

    def set(self, x: int) -> np.ndarray:
        return self.tokens[self.starts[x] : self.starts[x + 1]]

    def candidates(self, x: int) -> np.ndarray:
        """Sets whose prefix meets that of x where positions leave room for the overlap; blocks without room are skipped unread."""
        n = int(self.n[x])
        own = self.set(x)[: n - -(-self.percent * n // 100) + 1]
        lens = self.block_at[own + 1] - self.block_at[own]
        b = tk.gather(np.arange(len(self.block_place)), self.block_at[own], lens)
        here = np.repeat(np.arange(len(own)), lens)
        room = 1 + np.minimum(n - here - 1, self.block_most[b] - self.block_place[b] - 1)
        b = b[room >= least_overlap(n + self.block_least[b], self.percent)]
        return np.unique(tk.gather(self.entry, self.block[b], self.block[b + 1] - self.block[b]))

    def added(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        got = tk.gather(self.lists, self.list_at[tokens], self.list_at[tokens + 1] - self.list_at[tokens])
        return np.bincount(got, minlength=len(self.n))

    def linked(self, x: int, overlap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(100 * overlap >= self.percent * (self.n[x] + self.n - overlap))


def join(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all that the links among `sets` (different, not empty) connect."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    index, label, out = Index(sets, percent), np.arange(len(sets)), []
    done = np.zeros(len(sets), bool)

    def unite(x: int, found: np.ndarray) -> None:
        for y in found[label[found] != label[x]].tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]

    for x in range(len(sets)):
        if len(out) == len(sets) - 1:
            break
        if done[x]:
            continue
        near = index.candidates(x)
        if not (label[near] != label[x]).any():
            continue
        overlap = index.added(index.set(x))
        similar = index.linked(x, overlap)
        unite(x, similar)
        done[x] = True
        for y in similar[~done[similar]].tolist():
            if len(out) == len(sets) - 1:
                break
            mine, theirs = index.set(x), index.set(y)
            derived = overlap - index.added(np.setdiff1d(mine, theirs, assume_unique=True)) + index.added(np.setdiff1d(theirs, mine, assume_unique=True))
            unite(y, index.linked(y, derived))
            done[y] = True
    return out


def _links(meet: DataFrame, percent: int) -> DataFrame:
    """a, b of links found in each group of rows with equal (comp, i, j), which stand together in a partition."""

    def run(batches):
        key, nodes, sets = None, [], []

        def flush():
            if len(nodes) < 2:
                return
            order = np.argsort([len(x) for x in sets], kind="stable").tolist()
            got = join([sets[o] for o in order], percent)
            if got:
                yield pa.RecordBatch.from_pydict({"a": [nodes[order[x]] for x, _ in got], "b": [nodes[order[y]] for _, y in got]})

        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:4]]
            data, offs = tk.flat(b.column(4))
            for *k, node, lo, hi in zip(*cols, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                if k != key:
                    yield from flush()
                    key, nodes, sets = k, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(data[lo:hi].tobytes(), np.uint64))
        yield from flush()

    return meet.select("comp", "i", "j", "node", "set").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node").mapInArrow(tidy(run), "a binary, b binary")


class First:
    """Which sets a task has not met before, so that copies in one task count once."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def of(self, marks: np.ndarray) -> np.ndarray:
        new = np.zeros(len(marks), bool)
        for i, x in enumerate(_nodes(marks).to_pylist()):
            if x not in self.seen:
                self.seen.add(x)
                new[i] = True
        if len(self.seen) > 1 << 20:
            self.seen.clear()
        return new


def _tokens(s: np.ndarray) -> np.ndarray:
    """Shingles without their last bit, as numbers of Spark's kind."""
    return (s >> np.uint64(1)).view(np.int64)


def _often(tokens: DataFrame, hot: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of one set in SAMPLE that stand in `hot` sets or more, and how often they were seen: 2^20 tokens at most."""
    few = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= max(-(-hot // SAMPLE), total // SAMPLE >> 20))
    got = few.toArrow().sort_by("token")
    return got["token"].to_numpy(), got["c"].to_numpy()


def _spread(rows: DataFrame, words: int, hot=None) -> DataFrame:
    """token, key, n, hot: the tokens of every set, its key and size, and for frequent tokens how often they were seen; copies in
    one task count once."""
    sent = rows.sparkSession.sparkContext.broadcast(hot) if hot is not None else None

    def run(batches):
        first = First()
        known, often = sent.value if sent else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            for _, _, s, offs in _sets(b.column(0), words):
                marks = fingerprints(s, offs)
                new, n = first.of(marks), np.diff(offs)
                token = _tokens(s[np.repeat(new, n)])
                before = np.zeros(len(token), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    before = np.where(known[at] == token, often[at], 0)
                n = n[new]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(marks[new, 0].view(np.int64), n)), pa.array(np.repeat(n, n)), pa.array(before)], names=["token", "key", "n", "hot"])

    return rows.select("text").mapInArrow(tidy(run), "token long, key long, n long, hot long")


def _columns(batches) -> list[np.ndarray]:
    """The whole of a partition of numbers: its size is set by the number of partitions."""
    whole = pa.Table.from_batches(parts) if (parts := list(batches)) else None
    return [c.to_numpy() for c in whole.columns] if whole is not None else []


def _emit(names: str, *columns: np.ndarray, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + most]) for c in columns], names=names.split())


def _elsewhere(batches):
    """Rows of tokens that stand in two sets, with the number of their rows as df. Tokens known to be frequent pass as they are."""
    got = _columns(batches)
    if not got:
        return
    token, key, n, hot = got
    free = hot > 0
    yield from _emit("token key n df", token[free], key[free], n[free], hot[free] + (1 << 40))
    order = np.flatnonzero(~free)
    order = order[np.argsort(token[order], kind="stable")]
    by = token[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(by), 1), bool), by[1:] != by[:-1])))
    if not len(first):
        return
    df = np.diff(np.append(first, len(by)))
    own = key[order]
    two = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), df)
    at = order[two]
    yield from _emit("token key n df", token[at], key[at], n[at], np.repeat(df, df)[two])


def _prefixes(percent: int):
    def run(batches):
        """The rarest of each set's shared tokens, one more than it can lack; none if it has too few to link at all."""
        got = _columns(batches)
        if not got:
            return
        token, key, n, df = got
        order = np.lexsort((token, df, key))
        token, key, n = token[order], key[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
        token, key, n = token[new], key[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(first, len(key)))
        spare = np.repeat(many - -(-percent * n[first] // 100), many)
        keep = np.arange(len(key)) - np.repeat(first, many) <= spare
        yield from _emit("token key n", token[keep], key[keep], n[keep])

    return run


def _lone(batches):
    """The key of its set for each token that no other set has."""
    got = _columns(batches)
    if not got:
        return
    token, key = got
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
    token, key = token[new], key[new]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    last = np.append(first[1:], True)
    yield from _emit("key", key[first & last])


def _parts(spark, tokens: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART))


def possible(sampled: DataFrame, classes: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """The rows of classes (key, n) that can link by the sample of their tokens (key, th, sample: an array). A table."""
    total = sampled.agg(F.coalesce(F.sum(F.size("sample")), F.lit(0))).first()[0]
    known, _ = _often(sampled.filter(F.pmod(F.col("th"), F.lit(SAMPLE)) == 0).select(F.explode("sample").alias("token")), hot, total)
    tokens = sampled.select(F.explode("sample").alias("token"), "key")
    if len(known):  # a token of many sets is alone in none
        tokens = tokens.join(F.broadcast(sampled.sparkSession.createDataFrame(pa.table({"token": known}))), "token", "left_anti")
    lone = tokens.repartition(_parts(sampled.sparkSession, total), "token").mapInArrow(tidy(_lone), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("lone"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return stored(classes.join(lone, "key", "left").filter(F.coalesce("lone", F.lit(0)) <= spare).drop("lone"), "possible")


def candidates(rows: DataFrame, total: int, words: int, percent: int, hot: int = HOT) -> DataFrame:
    """key, label: the groups of sets that can link, sets by the first half of their hashes. A table.

    rows (th, text) are the texts of sets with `total` tokens. Tokens are dealt by token, those that stand in two sets by set; the
    number of partitions follows the number of tokens, so that each has about PART of them. Tokens that a sample of the sets has
    often, a bounded list, are counted by it and are not dealt by token: any order of tokens loses no link."""
    parts = _parts(rows.sparkSession, total)
    known = _often(_spread(rows.filter(F.pmod(F.col("th"), F.lit(SAMPLE)) == 0), words), hot, total)
    tokens = _spread(rows, words, known).repartition(parts, F.when(F.col("hot") > 0, F.col("key")).otherwise(F.col("token")))
    shared = tokens.mapInArrow(tidy(_elsewhere), "token long, key long, n long, df long").repartition(parts, "key")
    prefix = shared.mapInArrow(tidy(_prefixes(percent)), "token long, key long, n long")
    # Sets that link are in the same cell of sizes or in neighbours: a token's sets of a cell meet its least one, and that the next cell's.
    prefix = stored(prefix.select("token", "key", _cell("n", percent).alias("cell")), "prefixes")
    least = prefix.groupBy("token", "cell").agg(F.min("key").alias("least"))
    to_least = prefix.join(least, ["token", "cell"]).select(F.col("key").alias("a"), F.col("least").alias("b"))
    to_next = least.select("token", (F.col("cell") + 1).alias("cell"), F.col("least").alias("a")).join(least, ["token", "cell"]).select("a", F.col("least").alias("b"))
    groups = stored(components(to_least.unionByName(to_next)).withColumnRenamed("node", "key"), "groups")
    discard(prefix)
    return groups


def _cell(n: str, percent: int):
    """The cell of a set's size: sizes of sets that link are in one cell or in two that follow each other."""
    return F.floor(F.log(n) / (np.log(100 / percent) * 1.0001 if percent < 100 else 1.0)).cast("long")


def join_documents(docs: DataFrame, words: int = 3, percent: int = 90, weight: int = WEIGHT, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row: the smallest id that links lead to, and the row's set.

    A text's set is its distinct shingles of `words` words (A-Z in lower case), as 64-bit hashes; with fewer words its whole
    sequence; null or empty texts have none and link with nothing. Sets link if 100 * |both| >= percent * |either|. Equal sets
    are one class (class_id: a 128-bit hash of the set, in hex), which is joined once. Rows with a null id take part; their component
    is that of their class, or null. Repeated rows each have a row. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))

    cut = min(1000, 20 * (100 - percent))  # of 1000 tokens, twice what a set may lack

    def sign(batches):
        first = First()
        for b in batches:
            for lo, hi, s, offs in _sets(b.column(2), words):
                marks = fingerprints(s, offs)
                token = _tokens(s)
                take = np.repeat(first.of(marks), np.diff(offs)) & (token % 1000 < cut)
                at = np.concatenate(([0], np.cumsum(take)))[offs]
                columns = [*(b.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(np.diff(offs)), _nodes(marks), pa.array(marks[:, 0].view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(token[take]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_shingles", "node", "key", "sample"])

    sampled = stored(rows.select("doc_id", "th", "text").mapInArrow(tidy(sign), "doc_id long, th long, n_shingles long, node binary, key long, sample array<long>"), "sampled")
    signed = stored(sampled.drop("sample"), "signed")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("rep"), F.first("key").alias("key"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    classes = stored(classes.select("node", "key", "n", "rows", "rep.doc_id", "rep.th"), "classes")
    some = possible(sampled.select("key", "th", "sample"), classes, percent, hot)
    discard(sampled)

    def texts(of: DataFrame) -> DataFrame:
        """th and text of the rows that stand for classes, at least."""
        keys = sided(of.select(F.col("doc_id").alias("rep"), F.col("th").alias("rep_th")).distinct(), 48)
        return rows.join(keys, rows.doc_id.eqNullSafe(F.col("rep")) & (rows.th == F.col("rep_th")), "left_semi").select("th", "text")

    total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    group = candidates(texts(some), total, words, percent, hot)
    inside = stored(group.join(some, "key").select("node", "n", "doc_id", "th", F.col("label").alias("comp")), "inside")
    load = inside.groupBy("comp").agg(F.sum("n").alias("load"))
    # A heavy group is split by size, so that linked sets are in the same cell or neighbours, and a heavy cell by hash; a
    # set goes to the tasks of its block with each block of these cells only.
    placed = inside.join(load, "comp").withColumn("g", F.when(F.col("load") <= weight, F.lit(0).cast("long")).otherwise(_cell("n", percent)))
    cells = placed.groupBy("comp", "g").agg(F.when(F.max("load") <= weight, 1).otherwise(F.ceil(F.sum("n") * 2 / weight)).cast("int").alias("blocks"))
    near = cells.select("comp", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)).alias("g"), F.struct(F.col("g").alias("of"), "blocks").alias("p"))
    near = near.groupBy("comp", "g").agg(F.collect_list("p").alias("near"))  # three at most
    placed = placed.join(cells, ["comp", "g"]).join(near, ["comp", "g"])
    place = lambda g, k: g * F.lit(1 << 32) + k
    placed = placed.withColumn("own", place(F.col("g"), F.pmod(F.xxhash64("node"), F.col("blocks")))).select("node", "comp", "own", "near")

    def sets(batches):
        for b in batches:
            for _, _, s, offs in _sets(b.column(0), words):
                view, at = s.tobytes(), (8 * offs).tolist()
                yield pa.RecordBatch.from_arrays([_nodes(fingerprints(s, offs)), pa.array([view[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["own_node", "set"])

    whole = texts(inside).select("text").mapInArrow(tidy(sets), "own_node binary, set binary").join(placed, F.col("own_node") == F.col("node"))
    meets = F.flatten(F.transform("near", lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda k: place(p["of"], k))))
    meet = whole.select("node", "comp", "own", "set", F.explode(meets).alias("other")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    links = stored(_links(meet, percent), "links")
    label = stored(components(links), "labels")
    discard(some, group, inside, links)
    # Rows that are alone in their class and without links are their own component.
    named = classes.join(label, "node", "left").filter("rows > 1 or label is not null").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "label").select(F.col("node").alias("of"), "component_id"), "components")
    discard(classes, label)
    out = signed.join(sided(named), F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.when(F.col("n_shingles") > 0, F.lower(F.hex("node"))).alias("class_id"))
