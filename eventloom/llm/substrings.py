"""Removal of byte strings that repeat anywhere, decided by a column-wise multi-document construction.

Which windows can be equal: every window of `size` bytes picks its least k-gram hash; equal windows pick equal k-grams at equal
places. Windows of a text that pick one k-gram are a region: a document of the construction. Regions with a k-gram that
stands nowhere else have no equal window and go no further; equal regions are one document.

The construction: regions with the same k-grams meet in a task. Round j inserts the symbol j places before the end of every
region at once, in the collection's Burrows-Wheeler transform, and with it a suffix in the sorted order, whose place and common
prefixes with its neighbours follow from the transform and the common prefixes before the round. After the last round,
windows are equal if the common prefix of neighbours has `size` bytes. The streams that a round reads and writes once, from
front to back, are arrays in memory: a task takes regions in lots of a fixed number, so their size is bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import discard, sided, stored

SIZE, GRAM = 200, 32
#: Regions of one lot; and the most with one k-gram that meet in a lot (more are compared window by window, see _crowded).
LOT, CROWD = 4096, 32_768
PIECE = 4 << 20
PLACE = 24


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of data[i : i + k] for each i, by joining hashes of halves."""
    with np.errstate(over="ignore"):
        have, power, width = tk.mix(data.astype(np.uint64) + np.uint64(1)), np.uint64(0x9E3779B97F4A7C15), 1
        out, done = None, 0
        while True:
            if k & width:
                if out is None:
                    out, done = have.copy(), width
                else:
                    out = have[: len(data)] * np.uint64(pow(0x9E3779B97F4A7C15, done, 1 << 64)) + np.concatenate((out[width:], np.zeros(min(width, len(out)), np.uint64)))
                    done += width
            if 2 * width > k:
                return tk.mix(out)
            have = have + np.concatenate((have[width:], np.zeros(min(width, len(have)), np.uint64))) * np.uint64(pow(int(power), width, 1 << 64))
            width *= 2


def regions(data: np.ndarray, offs: np.ndarray, size: int = SIZE, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, place of the k-gram, k-gram hash and region hash of every region of the rows."""
    out = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    got = [[x] for x in out]
    lens = np.diff(offs)
    for row in np.flatnonzero(lens > PIECE).tolist():
        for at in range(0, int(lens[row]) - size + 1, PIECE):
            part = data[offs[row] + at : min(offs[row + 1], offs[row] + at + PIECE + size - 1)]
            r = _regions(part, np.array([0, len(part)]), size, k)
            for g, x in zip(got, (np.full(len(r[0]), row), r[1] + at, *r[2:]), strict=True):
                g.append(x)
    if (lens <= PIECE).all():
        return _regions(data, offs, size, k)
    for row in np.flatnonzero(lens <= PIECE).tolist():
        r = _regions(data[offs[row] : offs[row + 1]], np.array([0, lens[row]]), size, k)
        for g, x in zip(got, (np.full(len(r[0]), row), *r[1:]), strict=True):
            g.append(x)
    return tuple(np.concatenate(g) for g in got)


def _regions(data: np.ndarray, offs: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    lens = np.diff(offs)
    n, w = len(data), size - k + 1
    starts = np.maximum(lens - size + 1, 0)
    v = tk.gather(np.arange(n), offs[:-1], starts)
    if not len(v):
        return *[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2
    h = gram_hashes(data, k)
    key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-(n + w) // w) * w, np.iinfo(np.uint64).max)
    full[:n] = key
    ahead = np.minimum.accumulate(full.reshape(-1, w), 1).ravel()
    behind = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[v], ahead[v + w - 1]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(lens)), starts)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    many = np.diff(np.append(first, len(v)))
    lo = v[first]
    view = memoryview(np.ascontiguousarray(data))
    own = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (lo + many + size - 1).tolist(), strict=True)), np.uint64, len(lo))
    return row[first], lo - offs[row[first]], many, at[first] - lo, h[at[first]], own


def _least(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(lcp[lo : hi]) of each range; the ranges' ends descend, so that nothing between them is read."""
    at = np.empty(2 * len(lo), np.int64)
    at[::2], at[1::2] = lo, hi
    return np.minimum.reduceat(lcp, at)[::2] if len(lo) else lcp[:0]


def construct(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (0: start of a text; else rank of the byte) of texts in descending order of length, and the
    common prefix, up to `size`, of each suffix with the one before. All empty suffixes come first, in the order of texts."""
    many = len(texts)
    lens = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lens)
    used = np.zeros(256, bool)
    used[flat] = True
    if used.sum() > 255:
        raise ValueError("a text is not UTF-8")
    flat = np.cumsum(used).astype(np.uint8)[flat]
    bwt, lcp, pos = np.zeros(many, np.uint8), np.zeros(many + 1, np.uint8), np.arange(many)
    for j in range(1, int(lens.max(initial=0)) + 1):
        live = int(np.searchsorted(-lens, -j, "right"))
        p, c, n = pos[:live], flat[ends[:live] - j], len(bwt)
        bwt[p] = c
        order = np.argsort(bwt, kind="stable")
        new = np.zeros(n, bool)
        new[p] = True
        i = np.flatnonzero(new[order])
        who = np.lexsort((p, c))
        q = i + live  # empty suffixes, then all symbols inserted so far; many - live ends come first in `order`
        p, c = p[who], c[who]
        before, after = order[np.maximum(i - 1, 0)], order[np.minimum(i + 1, n - 1)]
        has_before, has_after = (i > 0) & (bwt[before] == c), (i + 1 < n) & (bwt[after] == c)
        down = np.argsort(-p)
        common = []
        for has, lo, hi in ((has_before, before + 1, p + 1), (has_after, p + 1, after + 1)):
            d = down[has[down]]
            x = np.zeros(live, np.uint8)
            x[d] = np.minimum(_least(lcp, lo[d], hi[d]), size - 1) + 1
            common.append(x)
        old = np.ones(n + live, bool)
        old[q] = False
        new_lcp, new_bwt = np.zeros(n + live + 1, np.uint8), np.zeros(n + live, np.uint8)
        new_lcp[:-1][old] = lcp[:-1]
        new_lcp[q] = common[0]
        new_lcp[q[has_after] + 1] = common[1][has_after]
        new_bwt[old] = bwt
        pos[who] = q
        bwt, lcp = new_bwt, new_lcp
    return bwt, lcp


def repeated(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each text, which of its windows of `size` bytes stand at another place of the texts too."""
    by = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    ordered = [texts[i] for i in by]
    bwt, lcp = construct(ordered, size)
    lens = np.array([len(t) for t in ordered])
    step = np.empty(len(bwt), np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    pos = np.arange(len(texts))
    out = [np.zeros(max(0, len(t) - size + 1), bool) for t in texts]
    found = np.zeros((len(texts), max(1, int(lens.max(initial=0)) - size + 1)), bool)
    for j in range(1, int(lens.max(initial=0)) + 1):
        live = int(np.searchsorted(-lens, -j, "right"))
        pos[:live] = step[pos[:live]]
        if j >= size:
            found[np.arange(live), lens[:live] - j] = (lcp[pos[:live]] >= size) | (lcp[pos[:live] + 1] >= size)
    for k, i in enumerate(by):
        out[i] = found[k, : len(out[i])]
    return out


def _spans(flags: np.ndarray, size: int) -> list[int]:
    """Starts and ends, in turn, of the bytes that flagged windows cover."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + size - 1), 1).ravel().tolist()


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def shared(group: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """For each (region, place of its k-gram), the stretch around the k-gram that any other region of the group can share: as
    far right and as far left as its closest neighbours in the order of what follows, and of what comes before backwards."""
    reach = []
    for parts in ([r[k:] for r, k in group], [r[:k][::-1] for r, k in group]):
        far, order = [0] * len(group), sorted(range(len(group)), key=parts.__getitem__)
        for i, j in zip(order[:-1], order[1:], strict=True):
            n = _common(parts[i], parts[j])
            far[i], far[j] = max(far[i], n), max(far[j], n)
        reach.append(far)
    return [(k - left, k + right) for (_, k), right, left in zip(group, *reach, strict=True)]


def _decide(meet: DataFrame, size: int) -> DataFrame:
    """f, rh, spans of each region with repeated windows; rows with equal f stand together.

    A region that has its k-gram alone is repeated where it stands again, and nowhere else. Of the others, only stretches that
    two regions can share, if `size` bytes long, are documents of the construction."""

    def run(batches):
        group: list[tuple] = []
        lot: list[tuple] = []
        hit: list[tuple] = []

        def close():
            for r in group:
                if r[2]:
                    hit.append((r[0], r[1], [0, len(r[3])]))
            if len(group) > 1:
                for r, (lo, hi) in zip(group, shared([(r[3], r[4]) for r in group]), strict=True):
                    if hi - lo >= size:
                        lot.append((r, lo, r[3][lo:hi]))

        def build():
            for (r, lo, _), flags in zip(lot, repeated([x[2] for x in lot], size), strict=True):
                if flags.any() and not r[2]:
                    hit.append((r[0], r[1], [lo + x for x in _spans(flags, size)]))
            lot.clear()

        def out():
            f, rh, spans = zip(*hit, strict=True)
            hit.clear()
            return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(rh, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["f", "rh", "spans"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and r[:2] == group[-1][:2]:
                    continue  # the same region of a row that repeats
                if group and r[0] != group[-1][0]:
                    close()
                    group = []
                    if len(lot) >= LOT:
                        build()
                    if len(hit) >= LOT:
                        yield out()
                group.append(r)
        close()
        if lot:
            build()
        if hit:
            yield out()

    return meet.select("f", "rh", "many", "region", "gram").repartition("f").sortWithinPartitions("f", "rh").mapInArrow(run, "f long, rh long, spans array<int>")


def _crowded(meet: DataFrame, size: int) -> DataFrame:
    """The same for k-grams with more than CROWD different regions: their windows are counted by 128-bit hashes, which are
    summed before they are shuffled, so that no task gets a crowd."""

    def windows(batches):
        for b in batches:
            for f, rh, many, region in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(region) - size + 1
                d = [xxhash.xxh3_128_digest(region[i : i + size]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int64()), pa.array([rh] * n, pa.int64()), pa.array([many] * n, pa.bool_()), pa.array(range(n), pa.int32()), pa.array(d, pa.binary())], names=["f", "rh", "many", "at", "w"])

    w = meet.select("f", "rh", "many", "region").dropDuplicates(["f", "rh"]).mapInArrow(windows, "f long, rh long, many boolean, at int, w binary")
    twice = w.groupBy("f", "w").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("c")).filter("c > 1").select("f", "w")
    hit = w.join(twice, ["f", "w"]).groupBy("f", "rh").agg(F.collect_list("at").alias("at"))
    return hit.select("f", "rh", F.flatten(F.transform(F.array_sort("at"), lambda a: F.array(a, a + size))).alias("spans"))


def remove(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and on demand the kept bytes as `kept`.

    Each byte covered by a string of `size` bytes that also starts anywhere else, in any row, goes; strings never cross
    rows, and are judged on the input. Null texts are empty; shorter texts stay; rows that repeat are covered by each other;
    rows with a null id take part. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))

    def find(batches):
        for b in batches:
            data, offs = tk.flat(b.column(2))
            for lo, _, part, po in tk.slices(data, offs):
                row, at, many, gram, f, rh = regions(part, po, size, min(GRAM, size))
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(f.view(np.int64)), pa.array(rh.view(np.int64))], names=["d", "th", "at", "n", "gram", "f", "rh"])

    found = rows.filter(F.octet_length("text") >= size).mapInArrow(find, "d long, th long, at int, n int, gram int, f long, rh long")
    found = stored(found, "regions")
    # Equal regions become one row before anything is dealt by k-gram, so a passage in a third of all rows is no hot spot.
    regions_ = found.groupBy("f", "rh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "th", "at", "n", "gram")).alias("first"))
    regions_ = stored(regions_, "kinds")
    twice = regions_.groupBy("f").agg(F.sum("c").alias("c")).filter("c > 1").select("f")
    first = regions_.join(twice, "f").select("f", "rh", (F.col("c") > 1).alias("many"), "first.*")
    lists = first.groupBy("d", "th").agg(F.collect_list(F.struct("f", "rh", "many", "at", "n", "gram")).alias("own")).withColumnsRenamed({"d": "ld", "th": "lth"})
    same = F.col("d").eqNullSafe(F.col("ld")) & (F.col("th") == F.col("lth"))

    def cut(batches):
        last = None
        for b in batches:
            data, offs = tk.flat(b.column(0))
            for base, own, *row in zip(offs[:-1].tolist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if row == last:
                    continue  # a row that repeats, mostly beside the first; _decide passes over any other
                last = row
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[x] for o in own], t) for x, t in (("f", pa.int64()), ("rh", pa.int64()), ("many", pa.bool_()), ("gram", pa.int32()))]
                    + [pa.array([data[base + o["at"] : base + o["at"] + o["n"] + size - 1].tobytes() for o in own], pa.binary())],
                    names=["f", "rh", "many", "gram", "region"],
                )

    meet = stored(rows.join(lists, same).select("text", "own", "d", "th").mapInArrow(cut, "f long, rh long, many boolean, gram int, region binary"), "meet")
    crowds = meet.groupBy("f").count().filter(F.col("count") > CROWD).select("f")
    crowds = stored(crowds, "crowds")
    if crowds.isEmpty():
        decided = _decide(meet, size)
    else:
        crowds = sided(crowds, 16)
        decided = _decide(meet.join(crowds, "f", "left_anti"), size).unionByName(_crowded(meet.join(crowds, "f", "left_semi"), size))
    decided = stored(decided, "decided")
    discard(meet, regions_)
    spans = found.select("d", "th", "at", "f", "rh").join(decided, ["f", "rh"]).select(F.col("d").alias("ld"), F.col("th").alias("lth"), F.transform("spans", lambda s: s + F.col("at")).alias("s")).groupBy("ld", "lth").agg(F.flatten(F.collect_set("s")).alias("spans"))

    def apply(batches):
        for b in batches:
            data, offs = tk.flat(b.column(1))
            out = []
            for lo, hi, s in zip(offs[:-1].tolist(), offs[1:].tolist(), b.column(2).to_pylist(), strict=True):
                own = data[lo:hi]
                if s:
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, s[::2], 1)
                    np.add.at(edge, s[1::2], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    own = own[~gone]
                    out.append((hi - lo, int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1)), own.tobytes()))
                else:
                    out.append((hi - lo, 0, 0, own.tobytes()))
            n, gone, many, kept = zip(*out, strict=True) if out else ([], [], [], [])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if with_text else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    whole = rows.join(spans, same, "left").select("d", "text", "spans")
    return whole.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
