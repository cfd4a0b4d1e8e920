"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import kept_rows, stored

BITS, BLOCK_BITS = 128, 16
#: Fingerprints of bags with similarity 0.8 differ in about 20 of 128 bits (standard deviation 4).
RADIUS = 31
#: Items of one pass over the documents: what a pass sends to the tasks is bounded by it (and by ITEM_BYTES of text).
ITEMS, ITEM_BYTES = 1000, 8 << 20


def _signs(h: np.ndarray) -> np.ndarray:
    """The BITS of each shingle as -1 and 1."""
    two = np.stack((tk.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), tk.mix(h + np.uint64(0x1234567))), 1)
    return np.unpackbits(two.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1, 2)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of one bag of shingles: each counts as often as it stands there."""
    return _pack(_signs(shingles).sum(0, dtype=np.int32)[None, :])[0]


def window_simhashes(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of shingles[s : s + size] for ascending starts s, from running sums over each stretch of them."""
    out = np.zeros((len(starts), 2), np.uint64)
    cut = np.flatnonzero((np.diff(starts) > size) | (np.arange(1, len(starts)) % 16_384 == 0)) + 1
    for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(starts)])).tolist(), strict=True):
        lo = starts[a]
        run = np.zeros((starts[b - 1] + size - lo + 1, BITS), np.int32)
        np.cumsum(_signs(shingles[lo : starts[b - 1] + size]), axis=0, out=run[1:], dtype=np.int32)
        at = starts[a:b] - lo
        out[a:b] = _pack(run[at + size] - run[at])
    return out


class Blocks:
    """Fingerprints by the values of their blocks, each also under all values within the block radius: if two fingerprints
    differ in at most `radius` bits, one of the BITS / BLOCK_BITS blocks differs in at most radius * BLOCK_BITS // BITS."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        near = radius * BLOCK_BITS // BITS
        masks = np.array([sum(1 << i for i in c) for r in range(near + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)
        parts = prints.view(np.uint16).astype(np.int64)
        keys = ((parts[:, :, None] ^ masks) | (np.arange(BITS // BLOCK_BITS) << BLOCK_BITS)[None, :, None]).reshape(len(prints), -1)
        who = np.repeat(np.arange(len(prints), dtype=np.int32), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.who = keys.ravel()[order].astype(np.int32), who[order]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (print, own print) that differ in at most `radius` bits."""
        keys = (prints.view(np.uint16).astype(np.int32) | (np.arange(BITS // BLOCK_BITS, dtype=np.int32) << BLOCK_BITS)[None, :]).ravel()
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        q = np.repeat(np.arange(len(keys)) // (BITS // BLOCK_BITS), hi - lo)
        pair = np.unique(q * len(self.prints) + tk.gather(self.who, lo, hi - lo))
        q, own = pair // len(self.prints), pair % len(self.prints)
        close = np.bitwise_count(prints[q] ^ self.prints[own]).sum(1) <= self.radius
        return q[close], own[close]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags: the sum of smaller counts over the sum of larger ones."""
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / max(1, len(a) + len(b) - both)


@dataclass
class Size:
    """Items of one number of shingles."""

    ids: list = field(default_factory=list)
    bags: list = field(default_factory=list)

    def ready(self, radius: int) -> Size:
        self.known = np.unique(np.concatenate(self.bags))
        self.blocks = Blocks(np.stack([simhash(b) for b in self.bags]), radius)
        return self


class Matcher:
    """Finds windows of texts that are as long as an item and as similar as `least`."""

    def __init__(self, items: list[tuple[int, str]], words: int, least: float, radius: int):
        self.words, self.least = words, least
        self.sizes: dict[tuple[int, int], Size] = {}
        data, offs = tk.flat(pa.array([t for _, t in items], pa.string()))
        w, bounds = tk.words(data, offs)
        h = tk.hashes(w)
        for (item, _), lo, hi in zip(items, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi > lo:
                k = min(words, hi - lo)
                bag, _ = tk.shingles(h[lo:hi], np.array([0, hi - lo]), k)
                size = self.sizes.setdefault((k, len(bag)), Size())
                size.ids.append(item)
                size.bags.append(bag)
        for s in self.sizes.values():
            s.ready(radius)
        self.known = {k: np.unique(np.concatenate([s.known for (k2, _), s in self.sizes.items() if k2 == k])) for k, _ in self.sizes}

    def find(self, data: np.ndarray, offs: np.ndarray):
        """(row, item, similarity, first word, words) of the best window of each row and item; ties to the first."""
        w, bounds = tk.words(data, offs)
        h = tk.hashes(w)
        best: dict[tuple, tuple] = {}
        for k, known in self.known.items():
            sh, at = tk.shingles(h, bounds, k)
            place = np.searchsorted(known, sh)
            hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == sh)
            if not len(hit):
                continue
            for (k2, m), size in self.sizes.items():
                if k2 == k:
                    own = hit[np.isin(sh[hit], size.known)]
                    for starts, length in self._windows(own, at, m):
                        for q, i in zip(*size.blocks.within(window_simhashes(sh, starts, length)), strict=True):
                            s = int(starts[q])
                            sim = similarity(sh[s : s + length], size.bags[i])
                            row = int(np.searchsorted(at, s, "right")) - 1
                            key = (row, size.ids[i])
                            if sim >= self.least and (key not in best or sim > best[key][0]):
                                first = s - int(at[row])
                                best[key] = (sim, first, min(length + k - 1, int(bounds[row + 1] - bounds[row])))
        return [(*key, *v) for key, v in sorted(best.items(), key=lambda x: x[0][0])]

    def _windows(self, hit: np.ndarray, at: np.ndarray, m: int):
        """Windows of m shingles, or whole shorter rows, of which enough shingles are some item's: without them, no item of m
        shingles can be similar enough, so no other window is looked at."""
        need = int(np.ceil(self.least * m - 1e-9))
        if len(hit) < need:
            return
        rows = np.searchsorted(at, hit, "right") - 1
        first, last = hit[: len(hit) - need + 1], hit[need - 1 :]
        lo, hi = np.maximum(last - m + 1, at[rows[need - 1 :]]), np.minimum(first, at[rows[: len(first)] + 1] - m)
        ok = (last - first < m) & (rows[: len(first)] == rows[need - 1 :]) & (lo <= hi)
        if ok.any():
            yield np.unique(tk.gather(np.arange(at[-1]), lo[ok], hi[ok] - lo[ok] + 1)), m
        row, n = np.unique(rows, return_counts=True)
        size = at[row + 1] - at[row]
        short = row[(n >= need) & (size < m)]
        for length in np.unique(at[short + 1] - at[short]).tolist():
            yield at[short[at[short + 1] - at[short] == length]], length


def _passes(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in lists of bounded number and bytes."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n * 5 // (4 * ITEMS)), -(-size * 2 // ITEM_BYTES)) if n > ITEMS or size > ITEM_BYTES else 1
    for p in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p) if parts > 1 else rows
        got = sorted({(r.i, r.t) for r in part.toLocalIterator()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if got:
            yield got


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each document's best window for each item it has.

    Words are split at white space, A-Z in lower case; a bag has all shingles of `words` words. For each length of an item,
    windows of that length get a 128-bit SimHash; index blocks find every item within `radius` bits, and the bags' weighted
    Jaccard similarity, `least` or more, decides. A text shorter than the item is one window; an item of fewer words is one
    shingle. The benchmark is read in passes of at most ITEMS items, each sent to all tasks; documents are never shuffled
    or collected. Null texts have no windows; null and repeated ids are kept as they are; an item without words, or an empty
    table on either side, gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for items in _passes(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            m = Matcher(sent.value, words, least, radius)
            for b in batches:
                data, offs = tk.flat(b.column(1))
                for lo, _, d, o in tk.slices(data, offs):
                    found = m.find(d, o)
                    if found:
                        row, item, sim, first, n = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + r for r in row])), pa.array(item, pa.int64()), pa.array(sim), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        if len(items) * 2 >= ITEMS:  # one of many passes: its rows are written and what was sent for it is released
            part = stored(part, "leaks")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.selectExpr("doc_id", "0L as item_id", "0D as similarity", "0L as first_word", "0L as n_words").limit(0)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = RADIUS, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have no window like an item (see leaks). A null text has none and stays; repeated
    rows are decided alike; without items or rows nothing goes."""
    for n, items in enumerate(_passes(benchmark, item_col, item_text)):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(texts, sent=sent, own=[]):
            if not own:  # one for each task
                own.append(Matcher(sent.value, words, least, radius))
            data, offs = tk.flat(texts)
            free = np.ones(len(texts), bool)
            for lo, _, d, o in tk.slices(data, offs):
                free[[lo + f[0] for f in own[0].find(d, o)]] = False
            return pa.array(free)

        docs = kept_rows(stored(docs, "clean") if n and n % 8 == 0 else docs, text_col, keep)
    return docs
