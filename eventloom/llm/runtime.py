"""Shared places and small helpers for the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this size.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the cluster names it.

    Only where the setting is absent is a folder of our own taken: on a local master a temporary one,
    elsewhere one beside the warehouse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        own = "file://" + tempfile.mkdtemp(prefix="eventloom-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a written table: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` wrote (told by their names), once what was made of them is itself written."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if re.search("-[0-9a-f]{32}$", folder):
                path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sided(df: DataFrame, row_bytes: int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """df as the broadcast side of a join if its rows, of row_bytes at most, fit in `most` bytes; else as it is, for a join by shuffle."""
    rows = most // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tidy(run):
    """run, and then what it freed goes back from the worker's memory pools to the system: workers are kept for tasks of other stages."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return whole


def kept_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of docs, with all their columns, that keep(texts: an Arrow array) says True of; a text of another type is read as a string."""
    own = docs.schema[text_col].dataType.simpleString() == "string"
    at = docs.columns.index(text_col) if own else len(docs.columns)

    def run(batches):
        for b in batches:
            yield b.filter(keep(b.column(at))) if own else b.select(range(at)).filter(keep(b.column(at)))

    name = "_text"
    while name in docs.columns:
        name += "_"
    return (docs if own else docs.withColumn(name, F.col(f"`{text_col}`").cast("string"))).mapInArrow(tidy(run), docs.schema)


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in (env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    if root not in ":".join(parts).split(":"):
        env["PYTHONPATH"] = ":".join([root, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
