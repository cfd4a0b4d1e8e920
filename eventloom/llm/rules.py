"""Quality rules: compression bands over whole documents and fixed chunks, after rules that count words and lines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import kept_rows

#: Bytes of a text, and the least and the most bytes that zstandard (LEVEL) makes of 1000 of them; between two lengths the limits go by the
#: logarithm. Prose takes fewer the longer it is, about a tenth above the lower limit; short texts vary more. Lists of one word, shouted
#: lines, tables and marks after each word come below, encoded or random bytes above.
BANDS = ((1, 450, 900), (256, 450, 880), (512, 490, 820), (1024, 470, 780), (2048, 440, 740), (4096, 420, 700), (8192, 402, 680), (16384, 388, 680), (32768, 376, 680), (65536, 360, 680), (131072, 345, 680), (262144, 330, 680))
LEVEL = 3
#: Bytes of a chunk; a shorter rest of the text under SHORT bytes belongs to the chunk before it. Chunks outside their bands may hold so much of a text.
CHUNK, SHORT, ODD_PERCENT = 4096, 1024, 25

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Bytes that begin a code point.
HEAD = (np.arange(256) & 0xC0) != 0x80

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
VERDICT = "n_bytes long, packed_bytes long, n_chunks int, low_chunks int, high_chunks int, reason string, kept boolean"


def _repeats(w: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Words of each row that stand in a 3-word window which the row has twice or more. Windows are told apart by their words, not by hashes."""
    code, row = tk.codes(w), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    covered = np.zeros(len(code) + 3, np.int64)
    if len(code) >= 3:
        base = int(code.max()) + 1
        at = np.flatnonzero(row[2:] == row[:-2])
        key = np.unique(row[at] * base + code[at], return_inverse=True)[1]
        for j in (1, 2):
            key, n = np.unique(key.astype(np.int64) * base + code[at + j], return_inverse=True, return_counts=True)[1:]
        many = at[n[key] > 1] if len(at) else at
        covered[many] += 1
        np.subtract.at(covered, many + 3, 1)
    return tk.per_row(np.cumsum(covered)[: len(code)] > 0, bounds)


def _dup_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Lines of each row with a word in them that equal an earlier line of the row."""
    out = np.zeros(len(offs) - 1, np.int64)
    feeds = tk.per_row(data == 10, offs)
    for i in np.flatnonzero(feeds).tolist():
        seen: set[bytes] = set()
        for line in data[offs[i] : offs[i + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                out[i] += line in seen
                seen.add(line)
    return out


def base(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The columns of COUNTS for each text."""
    w, bounds = tk.words(data, offs, lower=False)
    n = np.diff(bounds)
    repeated = _repeats(w, bounds)
    return [n, tk.per_row(HEAD[data] & ~tk.SPACE[data], offs), tk.per_row(SYMBOLS[data], offs), _dup_lines(data, offs), repeated, (n < 50) | (100 * repeated > 50 * n)]


class Bands:
    """Tells a text whose zstandard ratio, as a whole or in too many of its chunks, lies outside the band of its length."""

    def __init__(self, bands=BANDS, level: int = LEVEL, chunk: int = CHUNK, short: int = SHORT, odd_percent: int = ODD_PERCENT):
        sizes, self.least, self.most = zip(*bands, strict=True)
        self.sizes = [math.log2(x) for x in sizes]
        self.level, self.chunk, self.short, self.odd_percent = level, chunk, short, odd_percent

    def _side(self, size: int, packed: int) -> int:
        """-1 below the band of this size, 1 above it, 0 inside."""
        at, of_1000 = math.log2(size), packed * 1000 / size
        return -1 if of_1000 < np.interp(at, self.sizes, self.least) else int(of_1000 > np.interp(at, self.sizes, self.most))

    def cuts(self, size: int) -> list[int]:
        """Where chunks begin and the last one ends."""
        at = list(range(0, size, self.chunk))
        if len(at) > 1 and size - at[-1] < self.short:
            at.pop()
        return [*at, size]

    def judge(self, texts: list[memoryview]) -> list[tuple]:
        """The columns of VERDICT for each text; an empty text has no chunk and is kept."""
        packer, out = zstandard.ZstdCompressor(level=self.level, write_checksum=False, write_content_size=False), []
        for t in texts:
            size = len(t)
            if not size:
                out.append((0, 0, 0, 0, 0, None, True))
                continue
            packed, cuts = len(packer.compress(t)), self.cuts(size)
            sides = [self._side(b - a, packed if len(cuts) == 2 else len(packer.compress(t[a:b]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            odd = {s: sum(b - a for a, b, x in zip(cuts[:-1], cuts[1:], sides, strict=True) if x == s) for s in (-1, 1)}
            whole = self._side(size, packed)
            reason = {-1: "repetitive", 1: "incompressible"}.get(whole)
            if reason is None and 100 * (odd[-1] + odd[1]) > self.odd_percent * size:
                reason = "repetitive chunks" if odd[-1] >= odd[1] else "incompressible chunks"
            out.append((size, packed, len(sides), sides.count(-1), sides.count(1), reason, reason is None))
        return out


def _columns(texts: pa.Array, bands: Bands) -> list[pa.Array]:
    """COUNTS and VERDICT of all texts; kept is False where base_failed is true."""
    data, offs = tk.flat(texts)
    counts, verdicts = [], []
    for _, _, d, o in tk.slices(data, offs):
        counts.append(base(d, o))
        view = memoryview(np.ascontiguousarray(d))
        verdicts += bands.judge([view[a:b] for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)])
    whole = [np.concatenate(c) for c in zip(*counts, strict=True)] if counts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    size, packed, chunks, low, high, reason, kept = map(list, zip(*verdicts, strict=True)) if verdicts else ([] for _ in range(7))
    kept = np.array(kept, bool) & ~whole[5]
    return [*map(pa.array, whole), pa.array(size, pa.int64()), pa.array(packed, pa.int64()), pa.array(chunks, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(reason, pa.string()), pa.array(kept)]


def judge(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of COUNTS and VERDICT of every row, from its whole text; nothing is shuffled.

    base_failed: fewer than 50 words, or over half of them in 3-word windows that the text has twice. kept: not base_failed, and the
    zstandard ratios of the text and of its chunks lie inside the bands of their lengths; reason names what is outside (null: nothing; it
    is told of texts that base_failed too). A null text is an empty one: no words, base_failed. A null id stays null; repeated rows each
    have a row and are judged alike; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    bands = bands or Bands()

    def run(batches):
        for b in batches:
            cols = _columns(b.column(1), bands)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *[c.split()[0] for c in f"{COUNTS}, {VERDICT}".split(", ")]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {COUNTS}, {VERDICT}")


def accepted(docs: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that judge() keeps."""
    bands = bands or Bands()
    return kept_rows(docs, text_col, lambda texts: _columns(texts, bands)[-1])
