"""Files as rows: JSON, JSON lines, CSV, TSV, XML, parquet and text, found by suffix or first character."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".xml": "xml", ".txt": "text"}


def sniff(spark: SparkSession, path: str) -> str:
    for suffix, kind in SUFFIX.items():
        if path.rstrip("/").endswith(suffix) or path.rstrip("/").endswith(suffix + ".gz"):
            return kind
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    first = head[0][0].strip()[:1] if head else ""
    return {"[": "json", "{": "jsonl", "<": "xml"}.get(first, "csv")


def read(spark: SparkSession, path: str, format: str = "auto", records: str | None = None, delimiter: str | None = None, row_tag: str = "item", schema=None) -> DataFrame:
    """Rows of one file or folder. records: dotted path of the list inside a JSON document; lines that are no JSON become {value}."""
    kind = sniff(spark, path) if format == "auto" else format
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        df = reader.option("multiLine", True).json(path)
        if records:
            parts = records.split(".")
            df = df.select(F.explode(F.col(".".join(f"`{p}`" for p in parts))).alias("r"))
            return df.select("r.*") if df.schema["r"].dataType.typeName() == "struct" else df.withColumnRenamed("r", "value")
        return df
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("inferSchema", schema is None).option("delimiter", delimiter or ("\t" if kind == "tsv" else ",")).csv(path)
    if kind == "xml":
        return reader.option("rowTag", row_tag).format("xml").load(path)
    return reader.text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of any shape as VARIANT data; a line that is no JSON is {"value": line}."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    data = F.coalesce(F.try_parse_json("value"), F.parse_json(F.to_json(F.struct("value"))))
    return text.select(data.alias("data"))


def stream(spark: SparkSession, path: str, schema, format: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder as they come, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(path)
