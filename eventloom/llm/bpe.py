"""Token ids of whole text columns with the tokenizers library.

A text is cut where no token can cross (before white space, and between an ASCII letter and one of the marks below),
each distinct piece is encoded once, and ids are gathered back. A row with white space outside ASCII is encoded whole,
and so is one that holds the text of a special token, which is that token as by the library's default.
The result equals encoding each text by itself; tests compare both.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as tk

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: ASCII marks that end a run of letters in either pattern; the apostrophe starts contractions and is not among them.
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
ODD_SPACE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Pieces kept per worker process, and the longest kept.
CACHE, CACHE_BYTES = 400_000, 32

_loaded: dict[str, Encoder] = {}


def encoder(path: str, lower: bool = False) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path, lower)
    return _loaded[path]


class Encoder:
    """lower: the vocabulary folds case itself, so that pieces can be shared in lower case."""

    def __init__(self, path: str, lower: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([ODD_SPACE, *(f"(?i:{a})" for a in added)])
        self.lower = lower
        self.kept: dict[bytes, bytes] = {}
        self.width = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        kept = self.kept
        got = [kept.get(p) for p in pieces]
        new = [i for i, g in enumerate(got) if g is None]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            for i, ids in zip(part, self._encode([pieces[i].decode() for i in part]), strict=True):
                got[i] = b = np.array(ids, self.width).tobytes()
                if len(kept) < CACHE and len(pieces[i]) <= CACHE_BYTES:
                    kept[pieces[i]] = b
        lens = np.fromiter(map(len, got), np.int64, len(got)) // np.dtype(self.width).itemsize
        return np.frombuffer(b"".join(got), self.width), lens

    def _slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, self.width), np.zeros(n, np.int64)
        if self.lower:
            data = tk.LOWER[data]
        space, letter, mark = tk.SPACE[data], LETTER[data], MARK[data]
        first = np.zeros(len(data), bool)
        first[1:] = (space[1:] & ~space[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        first[offs[:-1][offs[:-1] < len(data)]] = True
        pos = np.flatnonzero(first)
        coded = tk.binary(data, np.append(pos, len(data))).dictionary_encode()
        flat, lens = self._pieces(coded.dictionary.to_pylist())
        u = coded.indices.to_numpy(zero_copy_only=False)
        ids = tk.gather(flat, (np.cumsum(lens) - lens)[u], lens[u])
        ends = np.concatenate(([0], np.cumsum(lens[u])))
        return ids, np.diff(ends[np.searchsorted(pos, offs)])

    def encode(self, column: pa.Array):
        """Yields (first row, ids of a run of rows, ids per row)."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        data, offs = tk.flat(column)
        for lo, hi, part, po in tk.slices(data, offs):
            if odd[lo:hi].any():
                cut = np.flatnonzero(np.diff(np.concatenate(([-1], odd[lo:hi].astype(int), [-1]))))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    if odd[lo + a]:
                        whole = self._encode(column.slice(lo + a, b - a).to_pylist())
                        yield lo + a, np.array([i for x in whole for i in x], self.width), np.array([len(x) for x in whole], np.int64)
                    else:
                        yield lo + a, *self._slice(part[po[a] : po[b]], po[a : b + 1] - po[a])
            else:
                yield lo, *self._slice(part, po)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each row's ids, as unsigned 32-bit ids, and the new offsets."""
    offs = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.empty(offs[-1], "<u4")
    last = np.zeros(offs[-1], bool)
    last[offs[1:] - 1] = True
    out[last], out[~last] = end, ids
    return out, offs
