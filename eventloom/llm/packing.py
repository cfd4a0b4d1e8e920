"""Cost-balanced packing of token ids into sequences of a fixed size."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder, with_end
from .runtime import tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ids that are packed together: bounds a task's memory, and spreads the padding of a pool's last sequence over that many ids.
POOL = 4 << 20
NONE = (float("inf"), -1)


class Room:
    """Open sequences by fill: a heap of (cost, sequence) for each fill below `size`, and a tree of the heaps' least ones, so
    that the cheapest of all sequences filled up to some level is found exactly, in steps of the logarithm of `size`."""

    def __init__(self, many: int, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.heaps = [[] for _ in range(size)]
        self.heaps[0] = [(0.0, i) for i in range(many)]
        self.least = [NONE] * (2 * self.leaves)
        self._mend(0)

    def _mend(self, level: int) -> None:
        least, k = self.least, level + self.leaves
        least[k] = self.heaps[level][0] if self.heaps[level] else NONE
        while k > 1:
            k >>= 1
            new = min(least[2 * k], least[2 * k + 1])
            if least[k] == new:
                break
            least[k] = new

    def add(self, i: int, cost: float, level: int) -> None:
        heapq.heappush(self.heaps[level], (cost, i))
        self._mend(level)

    def _take(self, k: int) -> int:
        while k < self.leaves:
            k = 2 * k if self.least[2 * k] == self.least[k] else 2 * k + 1
        i = heapq.heappop(self.heaps[k - self.leaves])[1]
        self._mend(k - self.leaves)
        return i

    def cheapest(self, level: int) -> int | None:
        """Takes out the cheapest sequence with at most `level` ids (the first of equal ones), if there is one."""
        lo, hi, best = self.leaves, self.leaves + level + 1, 0
        while lo < hi:
            if lo & 1:
                best, lo = lo if self.least[lo] < self.least[best] else best, lo + 1
            if hi & 1:
                hi -= 1
                best = hi if self.least[hi] < self.least[best] else best
            lo, hi = lo >> 1, hi >> 1
        return self._take(best) if self.least[best] != NONE else None

    def emptiest(self) -> int:
        k = 1
        while k < self.leaves:
            k = 2 * k if self.least[2 * k] != NONE else 2 * k + 1
        return self._take(k)


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    Full windows of long documents are sequences of their own. What remains goes, in descending order of estimated
    attention cost, to the sequence of the lowest cost so far that has room for it, among all; there are as many sequences as the
    ids need, and only a piece that no sequence has room for is cut, over the emptiest ones. So less than one sequence is padding.
    """
    pieces, nxt, rest = [], 0, []
    for d, n in enumerate(lengths.tolist()):
        full = n // size
        pieces += [(d, i * size, size, nxt + i, 0) for i in range(full)]
        nxt += full
        if n % size:
            rest.append((n % size, d, full * size))
    rest.sort(key=lambda x: (-(linear * x[0] + quadratic * x[0] * x[0]), x[1]))
    many = -(-sum(n for n, _, _ in rest) // size)
    fill, cost = [0] * many, [0.0] * many
    room = Room(many, size)

    def put(i, d, start, n):
        pieces.append((d, start, n, nxt + i, fill[i]))
        fill[i] += n
        cost[i] += linear * n + quadratic * n * n
        if fill[i] < size:
            room.add(i, cost[i], fill[i])

    for n, d, start in rest:
        i = room.cheapest(size - n)
        if i is not None:
            put(i, d, start, n)
            continue
        # None has room: none of those taken for an earlier cut comes back before this one is whole.
        cut = []
        while n:
            i = room.emptiest()
            m = min(n, size - fill[i])
            cut.append((i, d, start, m))
            start, n = start + m, n - m
        for x in cut:
            put(*x)
    return pieces


def _rows(docs: list, ids: list[np.ndarray], offs: np.ndarray, first: int, size: int, linear: float, quadratic: float) -> tuple[pa.RecordBatch, int]:
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    got = np.array(assign(np.diff(offs), size, linear, quadratic), np.int64).reshape(-1, 5)
    d, start, length, seq, at = got.T
    lo = offs[d] + start
    view = memoryview(flat.tobytes())
    crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(lo.tolist(), length.tolist(), strict=True)]
    cols = [pa.array(docs, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(offs)[d]), pa.array(seq + first), pa.array(at)]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")]), int(seq.max()) + 1 if len(seq) else 0


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document in sequences of at most `size` ids.

    Each document is its text's ids and then end_id; a null or empty text is the end id alone. A task packs its own rows in
    pools of about `pool` ids, so nothing is shuffled and memory is bounded by the pool and the longest text; sequence_id is
    unique over all tasks. Cost of a piece of n ids: linear * n + quadratic * n * n. Null ids stay null; repeated rows are
    packed each; other columns are ignored. vocabulary: file for the tokenizers library, on every machine.
    """

    def run(batches):
        enc = encoder(vocabulary)
        nxt = TaskContext.get().partitionId() << 32
        names, ids, lens, have = [], [], [], 0

        def flush():
            nonlocal nxt, names, ids, lens, have
            offs = np.concatenate(([0], np.cumsum(np.concatenate(lens))))
            out, used = _rows(names, ids, offs, nxt, size, linear, quadratic)
            nxt += used
            names, ids, lens, have = [], [], [], 0
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, got, counts in enc.encode(batch.column(1)):
                out, offs = with_end(got, counts, end_id)
                names += keys[lo : lo + len(counts)]
                ids.append(out)
                lens.append(np.diff(offs))
                have += len(out)
                if have >= pool:
                    yield flush()
        if have:
            yield flush()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(tidy(run), SCHEMA)
