"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import kept_rows, tidy

SYMBOLS = '!|#%$&*?:;-_=/\\<>()[]{}@^~"\''
NAMES = [
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "period", "comma", "other_mark", "non_ascii", "space", "byte_entropy",
    *(f"mark_{ord(c)}" for c in SYMBOLS), "lines", "line_words", "repeated_lines", "longest_line", "distinct_words", "top_word", "same_as_before",
    "short_words", "long_words", "capitalised", "ends_in_mark", "no_letter", "all_upper", "sentence_words",
]

#: Bit 0: a letter or any byte outside ASCII; bit 1: a-z.
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[97:123] |= 2


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x / np.maximum(n, 1)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text, from its whole UTF-8 bytes."""
    n = len(offs) - 1
    size = np.diff(offs)
    row = np.repeat(np.arange(n), size)
    hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    letters = hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1)
    p = hist / np.maximum(size, 1)[:, None]
    marks = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
    out = [np.log1p(size), None, None, _share(hist[:, 65:91].sum(1), letters), _share(letters, size), _share(hist[:, 48:58].sum(1), size), p[:, 46], p[:, 44]]
    out += [_share(hist[:, marks].sum(1) - hist[:, 46] - hist[:, 44], size), _share(hist[:, 128:].sum(1), size), _share(hist[:, [32, *range(9, 14)]].sum(1), size)]
    out += [-(p * np.log(np.where(p > 0, p, 1))).sum(1), *(p[:, ord(c)] for c in SYMBOLS)]
    del row

    w, bounds = tk.words(data, offs, lower=False)
    counts = np.diff(bounds)
    wrow = np.repeat(np.arange(n), counts)
    wdata = np.frombuffer(w.buffers()[2], np.uint8) if len(w) else np.zeros(0, np.uint8)
    wo = np.frombuffer(w.buffers()[1], np.int64)[: len(w) + 1]
    wlen = np.diff(wo)
    out[1], out[2] = np.log1p(counts), _share(np.bincount(wrow, wlen, n), counts)
    by_row = lambda mask: _share(np.bincount(wrow[mask], minlength=n), counts)

    # lines: hashes of the bytes between line feeds
    cut = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offs[:-1][size > 0], cut[~np.isin(cut, offs)] if len(cut) else cut)
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(offs, starts, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    if len(starts):
        ends = np.append(starts[1:], len(data))
        lh = tk.hashes(tk.binary(data, np.append(starts, len(data))))
        _, lo = tk.distinct_sets(lh, np.searchsorted(line_row, np.arange(n + 1)))
        longest = np.zeros(n)
        np.maximum.at(longest, line_row, ends - starts)
    else:
        lo, longest = np.zeros(n + 1, np.int64), np.zeros(n)
    out += [np.log1p(lines), _share(counts, lines), 1 - _share(np.diff(lo), np.maximum(lines, 1)), np.log1p(longest)]

    coded = w.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.sort(wrow * max(len(coded.dictionary), 1) + word)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    run_row = key[at] // max(len(coded.dictionary), 1)
    most = np.zeros(n)
    np.maximum.at(most, run_row, np.diff(np.append(at, len(key))))
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (wrow[1:] == wrow[:-1])
    out += [_share(np.bincount(run_row, minlength=n), counts), _share(most, counts), by_row(same)]

    if len(w):
        ahead, last = wdata[wo[:-1]], wdata[wo[1:] - 1]
        kinds = np.bitwise_or.reduceat(KIND[wdata], wo[:-1])
        some, low = (kinds & 1) > 0, (kinds & 2) > 0
        cap = (ahead >= 65) & (ahead <= 90)
        end = (last < 128) & ~((last | 32) >= 97) & ~((last >= 48) & (last <= 57)) & (last != 46) & (last != 44)
        stops = np.bincount(wrow[last == 46], minlength=n)
        out += [by_row(wlen <= 2), by_row(wlen > 20), by_row(cap), by_row(end), by_row(~some), by_row(some & ~low & (wlen > 1)), np.log1p(_share(counts, stops))]
    else:
        out += [np.zeros(n)] * 7
    return np.stack(out, 1).astype(np.float32)


@dataclass
class Trees:
    """Complete trees of one depth, level by level: node i's children are 2i + 1 (value <= threshold) and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels by Newton steps over histograms of binned features. Without rows, every score is 0.5."""
    n, m = x.shape
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    mean = (y.sum() + 1) / (n + 2)
    prior = float(np.log(mean / (1 - mean)))
    if not n:
        return Trees(feature, threshold, leaf, 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = code + np.arange(m) * bins
    f = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            k, base = 1 << d, (1 << d) - 1
            key = ((node - base)[:, None] * (m * bins) + flat).ravel()
            G, H, N = (np.bincount(key, np.repeat(v, m), k * m * bins).reshape(k, m, bins).cumsum(2) for v in (g, h, np.ones(n)))
            tg, th, tn = G[:, :1, -1:], H[:, :1, -1:], N[:, :1, -1:]
            gain = G**2 / (H + ridge) + (tg - G) ** 2 / (th - H + ridge) - tg**2 / (th + ridge)
            gain[(N < least) | (tn - N < least)] = 0
            top = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                j, b = divmod(int(top[i]), bins)
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, base + i], threshold[t, base + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        f += leaf[t][at]
    return Trees(feature, threshold, leaf, prior)


def _table(texts: pa.Array) -> np.ndarray:
    data, offs = tk.flat(texts)
    got = [statistics(d, o) for _, _, d, o in tk.slices(data, offs)]
    return np.concatenate(got) if got else np.zeros((0, len(NAMES)), np.float32)


def held_out(id_col: str, mod: int):
    """crc32 of the id as text is divisible by mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % mod == 0


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5) -> Trees:
    """Fit on labelled documents outside the held-out fold, at most `most` label rows (those first in the order of a hash of
    the id; this bound is why the rows may be broadcast and the statistics collected). Rows without label, id or text row take no part."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, mod))
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            x = _table(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["_y", "x"])

    got = texts.join(F.broadcast(rows), "_id").select("_y", "_text").mapInArrow(tidy(run), "_y int, x binary").orderBy(F.xxhash64("x"), "x", "_y").limit(2 * most).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, len(NAMES))
    return fit(x, got["_y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text; a null text is empty and has a score too. Repeated
    rows each have a row; other columns are ignored; an empty table gives none."""

    def run(batches):
        for b in batches:
            s = model.scores(_table(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col, mod).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores threshold or more; a null text is an empty one, repeated rows are judged
    alike, and an empty table stays empty."""
    return kept_rows(docs, text_col, lambda texts: pa.array(model.scores(_table(texts)) >= threshold))
