"""Numbered recordings as sources: frames of a message stream by cursor, logs of a chain by block. Both go on where they stopped.

A recording is a folder of Parquet files with `position` (a cursor in microseconds, or a block) and `payload`, in the order of their positions. Spark
keeps the position that a query has reached in its checkpoint and asks for the rows after it; so a query that stopped, or failed in a
batch, reads what it had not finished and nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "position long, payload string"
#: Rows that a worker holds at once, and bytes that it reads at once.
BATCH, BUFFER = 4096, 1 << 20


def record(rows: DataFrame, path: str, position: str, payload: str = "payload") -> None:
    """Add rows to a recording: dealt by ranges of positions and ordered in each file, so that a range is in few row groups."""
    out = rows.select(F.col(position).cast("long").alias("position"), F.col(payload).cast("string").alias("payload")).filter("position is not null")
    out.repartitionByRange("position").sortWithinPartitions("position").write.mode("append").parquet(path)


@dataclass
class Piece(InputPartition):
    """Rows of some row groups whose positions lie after lo and up to hi."""

    lo: int
    hi: int
    groups: list[tuple[str, int]]


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Recording:
    """The row groups of a recording by their least and greatest positions, from the files' footers; each file is looked at once."""

    def __init__(self, path: str):
        self.fs, self.root = _place(path)
        self.groups: dict[str, list[tuple[int, int, int]]] = {}

    def refresh(self) -> Recording:
        for f in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True)):
            if f.path.endswith(".parquet") and f.path not in self.groups:
                with self.fs.open_input_file(f.path) as file:
                    meta = pq.ParquetFile(file).metadata
                    at = meta.schema.names.index("position")
                    stats = [(i, meta.row_group(i).column(at).statistics) for i in range(meta.num_row_groups)]
                self.groups[f.path] = [(i, s.min, s.max) for i, s in stats if s is not None and s.has_min_max]
        return self

    def span(self) -> tuple[int, int] | None:
        """The first and the last position; None without rows."""
        every = [g for file in self.groups.values() for g in file]
        return (min(lo for _, lo, _ in every), max(hi for _, _, hi in every)) if every else None

    def overlapping(self, lo: int, hi: int) -> list[tuple[str, int, int, int]]:
        return sorted((f, i, a, b) for f, file in self.groups.items() for i, a, b in file if b > lo and a <= hi)

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        for path, i in piece.groups if piece else ():  # without partitions Spark asks for None
            with self.fs.open_input_file(path) as file:
                # In batches from a small buffer: a row group is never whole in a worker's memory.
                group = pq.ParquetFile(file, buffer_size=BUFFER, pre_buffer=False)
                for rows in group.iter_batches(BATCH, [i], ["position", "payload"]):
                    yield rows.filter(pc.and_(pc.greater(rows["position"], piece.lo), pc.less_equal(rows["position"], piece.hi)))
            pa.default_memory_pool().release_unused()


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        get = lambda k, d: int(options.get(k, d))
        self.start = options.get("start", "earliest")
        self.lag, self.range, self.bound, self.behind, self.recent = get("lag", 0), get("range", 0), get("bound", 0), get("behind", 0), get("recent", 0)
        self.progress = options.get("progress")
        if self.bound and not self.progress:
            raise ValueError("bound needs `progress`: a file of this query alone that says how far it has planned")

    def begin(self, recording: Recording) -> int:
        """The position before the first that a new query reads."""
        if self.start not in ("earliest", "recent"):
            return int(self.start)
        span = recording.span()
        if span is None:
            return -1
        return span[0] - 1 if self.start == "earliest" else max(span[0] - 1, span[1] - self.lag - self.recent)

    def pieces(self, recording: Recording, lo: int, hi: int) -> list[Piece]:
        """Partitions of (lo, hi]: ranges of `range` positions, or single row groups."""
        if hi <= lo:
            return []
        lo = max(lo, hi - self.behind) if self.behind else lo
        groups = recording.overlapping(lo, hi)
        if not self.range:
            return [Piece(lo, hi, [(f, i)]) for f, i, *_ in groups]
        out = []
        for a in range(lo, hi, self.range):
            b = min(a + self.range, hi)
            own = [(f, i) for f, i, least, most in groups if most > a and least <= b]
            if own:
                out.append(Piece(a, b, own))
        return out


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.options, self.recording = options, Recording(options.path)

    def partitions(self) -> list[Piece]:
        span = self.recording.refresh().span()
        return self.options.pieces(self.recording, self.options.begin(self.recording), span[1] - self.options.lag) if span else []

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Recording(self.options.path).read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are positions. Up to `lag` positions before the newest are left for later: they are read once nothing can replace them. With
    `bound`, a batch takes no more positions than that after the last planned one, which is kept in the file `progress`."""

    def __init__(self, options: _Options):
        self.options, self.recording = options, Recording(options.path)

    def initialOffset(self) -> dict:
        return {"position": self.options.begin(self.recording.refresh())}

    def _planned(self) -> int | None:
        fs, path = _place(self.options.progress)
        try:
            with fs.open_input_file(path) as f:
                return json.loads(f.read())["position"]
        except FileNotFoundError:
            return None

    def _plan(self, position: int) -> None:
        fs, path = _place(self.options.progress)
        own = f"{path}-{uuid.uuid4().hex}"
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(own) as f:
            f.write(json.dumps({"position": position}).encode())
        fs.move(own, path)

    def latestOffset(self) -> dict:
        span = self.recording.refresh().span()
        begin = self.options.begin(self.recording)
        head = max(span[1] - self.options.lag, begin) if span else begin
        if self.options.bound:
            planned = self._planned()
            planned = begin if planned is None else planned
            head = max(planned, min(head, planned + self.options.bound))
        return {"position": head}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.options.bound and end["position"] > (self._planned() if self._planned() is not None else start["position"]):
            self._plan(end["position"])  # never behind what the checkpoint has, so that no batch goes back
        return self.options.pieces(self.recording.refresh(), start["position"], end["position"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Recording(self.options.path).read(partition)


class RecordedFrames(DataSource):
    """Frames of a message stream: `path`, `start` (earliest, or a cursor). A partition is a row group of what is new."""

    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(_Options(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(_Options(self.options))


class BlockRanges(RecordedFrames):
    """Logs of a chain: `path`; `lag`, blocks that are too new to be sure of; `range`, blocks that one request may ask for, which make a partition;
    `bound`, blocks of one batch; `behind`, blocks that a query which is far behind still reads, the older ones being left out; `start`,
    earliest, recent (the last `recent` blocks) or a block."""

    @classmethod
    def name(cls) -> str:
        return "block_ranges"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedFrames)
    spark.dataSource.register(BlockRanges)


def frames(spark: SparkSession, path: str, stream: bool = True, **options) -> DataFrame:
    register(spark)
    r = spark.readStream if stream else spark.read
    return r.format("recorded_frames").options(path=path, **options).load()


def blocks(spark: SparkSession, path: str, stream: bool = True, lag: int = 12, range: int = 500, **options) -> DataFrame:  # noqa: A002
    register(spark)
    r = spark.readStream if stream else spark.read
    return r.format("block_ranges").options(path=path, lag=lag, range=range, **options).load()
