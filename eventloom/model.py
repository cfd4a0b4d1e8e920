"""The event: the one record that flows, and how rows become events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .functions import values as V

ENVELOPE = ["id", "source", "type", "key", "source_url", "timestamp", "observed_at", "data", "metadata", "provenance"]
STEP = "array<struct<step:string,version:string,args:string>>"


def to_events(df: DataFrame, source: str, type: str = "record", key: Column | None = None, time: Column | None = None, data: Column | None = None, url: Column | None = None, observed: str | None = None) -> DataFrame:
    """Rows as events: all columns are data unless given; the id is that of source, key and data."""
    data = data if data is not None else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    none = F.lit(None).cast("string")
    k = none if key is None else key.cast("string")
    u = none if url is None else url
    canonical = F.to_json(F.parse_json(F.to_json(data)))  # keys in order, no spaces
    ts = none if time is None else V.iso(time.cast("timestamp"))
    seen = F.lit(observed) if observed else V.iso(F.current_timestamp())
    return df.select(X.event_id(F.lit(source), F.coalesce(k, u), canonical).alias("id"), F.lit(source).alias("source"), F.lit(type).alias("type"), k.alias("key"), u.alias("source_url"), ts.alias("timestamp"), seen.alias("observed_at"), data.alias("data"), F.create_map().cast("map<string,string>").alias("metadata"), F.array().cast(STEP).alias("provenance"))


def stamp(df: DataFrame, step: str, version: str = "1", args: str | None = None) -> DataFrame:
    """The step at the end of each event's lineage."""
    if "provenance" not in df.columns:
        return df
    return df.withColumn("provenance", F.array_append("provenance", F.struct(F.lit(step).alias("step"), F.lit(version).alias("version"), F.lit(args).cast("string").alias("args"))))


def label(df: DataFrame) -> Column:
    """What an event is called: its title, name or label, else key, URL or id."""
    t = df.schema["data"].dataType
    names = [F.when(F.trim(F.col(f"data.{n}")) != "", F.col(f"data.{n}")) for n in ("title", "name", "label") if isinstance(t, T.StructType) and n in t.names]
    return F.coalesce(*names, "key", "source_url", "id")


def event_time(df: DataFrame) -> Column:
    return F.coalesce(V.parse_time(V.Value("str", F.col("timestamp"))), V.parse_time(V.Value("str", F.col("observed_at"))))
