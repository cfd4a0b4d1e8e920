"""Arrow text columns as flat numpy arrays: words, chunks, hashes and shingles without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part terms: ASCII other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SLICE_BYTES = 2 << 20


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = arr.buffers()
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary values over data, without a copy of it."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes (one row at least): first row, end row, bytes, offsets."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True, apart: np.ndarray = SPACE) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all rows, or what other bytes `apart` part, A-Z in lower case on demand, and the n+1 word offsets of the rows."""
    if lower:
        data = LOWER[data]
    keep = ~apart[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    first[at] = keep[at]
    pos = np.flatnonzero(first)
    if not len(pos):
        return binary(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(len(offs), np.int64)
    sizes = np.add.reduceat(keep.view(np.uint8), pos, dtype=np.int64)
    return binary(data[keep], np.concatenate(([0], np.cumsum(sizes)))), np.searchsorted(pos, offs)


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value; each distinct value is hashed once."""
    coded = values.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weight(j: int) -> np.uint64:
    return mix(np.array([0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1], np.uint64))[0] | np.uint64(1)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, and their n+1 offsets. A row of fewer words has its whole sequence as one; without words, none."""
    with np.errstate(over="ignore"):
        counts = np.diff(bounds)
        out_n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        out_offs = np.concatenate(([0], np.cumsum(out_n)))
        out = np.zeros(out_offs[-1], np.uint64)
        if len(h) >= k:
            s = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                s += h[j : len(h) - k + 1 + j] * _weight(j)
            whole = counts >= k
            take = np.repeat(bounds[:-1][whole] - out_offs[:-1][whole], out_n[whole])
            dest = np.flatnonzero(np.repeat(whole, out_n))
            out[dest] = mix(s[take + dest] + np.uint64(k))
        for c in range(1, k):
            rows = np.flatnonzero(counts == c)
            if len(rows):
                s = np.full(len(rows), c, np.uint64)
                for j in range(c):
                    s += h[bounds[:-1][rows] + j] * _weight(j)
                out[out_offs[:-1][rows]] = mix(s)
        return out, out_offs


def distinct_sets(sh: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and their offsets."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    order = np.argsort(sh, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    s, r = sh[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return s, np.searchsorted(r, np.arange(n + 1))


def codes(values: pa.Array) -> np.ndarray:
    """A number of each binary value, the same for equal ones."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many true entries each row has."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lens[i]] of all i, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)]
