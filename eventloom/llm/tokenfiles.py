"""Token ids in patched frame-of-reference files.

A file holds the documents of one range of ids, in ascending order:

    "PFR1"  frame*  footer  <u8 footer bytes>  "PFR1"

A frame has up to FRAME ids in blocks of BLOCK. Its sections, in order: <u4 number of ids, number of exceptions, bytes of
planes>; block minima <u4; widths u1; exceptions of each block <u2; index: <u4 start of each block in the planes; planes;
positions of exceptions in their blocks u1; their values above the minimum <u4. A block's plane i is bit i of (id - minimum)
of its ids, 32 bytes. A block's width is the least that holds PERCENTILE of its ids; wider ones are exceptions, whose low
bits are in the planes too and are patched over. The footer has <u8 number of documents, of ids, of frames; the starts of
frames <u8; document ids <i8; nulls among them u1; ids of all documents up to and with each <u8.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .runtime import scratch, sided, stored

#: Ids of a file, about: a file is read back as one row, whose size this bounds.
FILE_IDS = 32 << 20
MAGIC, BLOCK, FRAME, PERCENTILE = b"PFR1", 256, 1 << 20, 0.9


def encode_frame(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, "<u4")
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    least = full.min(1)
    over = full - least[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.frexp(np.partition(over, at, 1)[:, at].astype(np.float64))[1].astype(np.uint8)
    wide = (over >> np.minimum(width, 31)[:, None]) * (width < 32)[:, None] > 0
    row, col = np.nonzero(wide)
    exceptions = np.bincount(row, minlength=blocks).astype("<u2")
    bytes_ = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(bytes_) - bytes_
    planes = np.zeros(int(bytes_.sum()), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for i in range(w):
            bits = np.packbits((over[rows] >> i & 1).astype(np.uint8), axis=1, bitorder="little")
            planes[(starts[rows] + i * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = bits
    head = struct.pack("<III", n, len(row), len(planes))
    return head + b"".join(x.tobytes() for x in (least.astype("<u4"), width, exceptions, starts.astype("<u4"), planes, col.astype(np.uint8), over[row, col].astype("<u4")))


def decode_frame(data: bytes) -> np.ndarray:
    n, many, plane_bytes = struct.unpack_from("<III", data)
    blocks, at = -(-n // BLOCK), 12
    out = []
    for kind, count in (("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u4", blocks), ("u1", plane_bytes), ("u1", many), ("<u4", many)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    least, width, exceptions, starts, planes, col, value = out
    over = np.zeros((blocks, BLOCK), "<u4")
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for i in range(w):
            bits = planes[(starts[rows].astype(np.int64) + i * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
            over[rows] |= np.unpackbits(bits, axis=1, bitorder="little").astype("<u4") << i
    over[np.repeat(np.arange(blocks), exceptions), col] = value
    return (over + least[:, None]).reshape(-1)[:n]


class Writer:
    """Writes one file to a binary stream, a frame at a time."""

    def __init__(self, out):
        self.out, self.at, self.frames, self.rest, self.n_ids = out, 0, [], np.zeros(0, "<u4"), 0
        self.docs: list = []
        self.ends: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _frame(self, ids: np.ndarray) -> None:
        self.frames.append(self.at)
        self._put(encode_frame(ids))

    def add(self, docs: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += docs
        self.ends.append(self.n_ids + np.cumsum(counts))
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids))
        while len(ids) >= FRAME:
            self._frame(ids[:FRAME])
            ids = ids[FRAME:]
        self.rest = ids.copy()

    def close(self) -> None:
        if len(self.rest):
            self._frame(self.rest)
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0)
        foot = struct.pack("<QQQ", len(docs), self.n_ids, len(self.frames)) + b"".join(x.tobytes() for x in (np.array(self.frames, "<u8"), docs, null, ends.astype("<u8")))
        self._put(foot)
        self._put(struct.pack("<Q", len(foot)) + MAGIC)


def documents(data: bytes):
    """(doc ids, first ids of the documents in the file, ids of all of them) by runs of documents, from a whole file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<Q", data, len(data) - 12)
    foot = len(data) - 12 - size
    n, _, frames = struct.unpack_from("<QQQ", data, foot)
    at = foot + 24
    starts = np.frombuffer(data, "<u8", frames, at).astype(np.int64)
    docs = np.frombuffer(data, "<i8", n, at + 8 * frames)
    null = np.frombuffer(data, "u1", n, at + 8 * (frames + n)).astype(bool)
    ends = np.frombuffer(data, "<u8", n, at + 8 * (frames + n) + n).astype(np.int64)
    limits = np.append(starts[1:], foot)[: len(starts)]
    held, base, done = np.zeros(0, "<u4"), 0, 0
    for lo, hi in zip(starts.tolist(), limits.tolist(), strict=True):
        held = np.concatenate((held, decode_frame(data[lo:hi])))
        upto = int(np.searchsorted(ends, base + len(held), "right"))
        if upto > done:
            first = np.concatenate(([base], ends[done:upto]))
            yield [None if z else d for d, z in zip(docs[done:upto].tolist(), null[done:upto].tolist(), strict=True)], first, held[: first[-1] - base]
            held, base, done = held[first[-1] - base :], int(first[-1]), upto
    if done < n:  # documents without ids after the last frame
        yield [None if z else d for d, z in zip(docs[done:].tolist(), null[done:].tolist(), strict=True)], np.full(n - done + 1, base), held


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each document's ids and end_id under path, in ascending id order over the files in order of their names.

    Texts go to ranges of ids; each task streams files of about file_ids ids to names of its own attempt and renames them, so that a
    task that runs again leaves each file once. Null texts are empty, null ids come first, rows of one id go in the order of a
    hash of their texts, repeated rows are written each. Returns the
    manifest: segment, n_docs, n_ids, and base, the ids in all files before.
    """
    ranged = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Rows of one id are dealt by their texts, equal rows at random: no id is one task.
    ranged = ranged.withColumns({"th": F.xxhash64("text"), "any": F.rand(7)}).repartitionByRange("doc_id", "th", "any").sortWithinPartitions("doc_id", "th").select("doc_id", "text")

    def run(batches):
        from pyarrow import fs

        enc, ctx = encoder(vocabulary, lower=True), TaskContext.get()
        done, store, writer = 0, None, None

        def close():
            nonlocal done, writer
            writer.close()
            out.close()
            name = f"{ctx.partitionId():08d}-{done:06d}"
            store.move(temp, f"{root}/{name}.pfr")
            row = pa.RecordBatch.from_pydict({"segment": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})
            done, writer = done + 1, None
            return row

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, ids, counts in enc.encode(batch.column(1)):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(path)
                    store.create_dir(root, recursive=True)
                    temp = f"{root}/_{ctx.partitionId():08d}-{done:06d}-{ctx.taskAttemptId()}"
                    out = store.open_output_stream(temp)
                    writer = Writer(out)
                ids, offs = with_end(ids, counts, end_id)
                writer.add(keys[lo : lo + len(counts)], ids, np.diff(offs))
                if writer.n_ids >= file_ids:
                    yield close()
        if writer:
            yield close()

    done = stored(ranged.mapInArrow(run, "segment string, n_docs long, n_ids long"), "manifest")
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read(spark, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, and on demand its ids, from the files under path and their manifest."""
    from pyspark.errors import AnalysisException

    out = "segment string, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = name.rpartition("/")[2].partition(".")[0]
                for docs, first, ids in documents(data.as_buffer().to_pybytes()):
                    view = memoryview(ids.tobytes())
                    at = (first - first[0]).tolist()
                    cols = {"segment": [segment] * len(docs), "doc_id": pa.array(docs, pa.int64()), "start": first[:-1], "n_tokens": np.diff(first), "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]}
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(cols)

    try:
        files = spark.read.format("binaryFile").load(f"{path}/*.pfr").select("path", "content")
    except AnalysisException:  # an empty table has no files
        files = spark.createDataFrame([], "path string, content binary")
    rows = files.mapInArrow(run, out)
    cols = ["doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return rows.join(sided(manifest.select("segment", "base"), 96), "segment").select(*cols)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    return read(docs.sparkSession, path, write(docs, path, vocabulary, end_id))


def to_bytes(docs: list, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One file in memory."""
    buf = io.BytesIO()
    w = Writer(buf)
    w.add(docs, np.asarray(ids, "<u4"), np.asarray(counts))
    w.close()
    return buf.getvalue()
