"""Outputs: JSON lines, one JSON array, flat CSV, feeds, an insert-or-ignore table, webhook payloads."""

from __future__ import annotations

import json
import urllib.request
from email.utils import format_datetime
from xml.sax.saxutils import escape, quoteattr

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.paths import flatten


def jsonl(df: DataFrame, path: str, data_only: bool = False, append: bool = False) -> None:
    body = F.to_json(F.col("data") if data_only else F.struct("*"), {"ignoreNullFields": "false"})
    df.select(body.alias("value")).write.mode("append" if append else "overwrite").text(path)


def json_array(df: DataFrame, path: str, order: str) -> None:
    """One document; its rows are streamed to it a partition at a time, so it may be larger than the driver's memory."""
    rows = df.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, r in enumerate(rows.toLocalIterator()):
            out.write(("," if i else "") + "\n" + r[0])
        out.write("\n]\n")


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Dotted columns of all leaves, or the given ones."""
    leaves = dict(flatten(df.schema))
    names = columns or list(leaves)
    df.select(*[leaves.get(n, F.lit(None).cast("string")).alias(n) for n in names]).write.mode("overwrite").option("header", True).csv(path)


def feed_items(df: DataFrame) -> DataFrame:
    """id, title, link, summary, date of events as a feed shows them; summaries end at a word, within 500 characters."""
    summary = F.coalesce("summary", F.lit(""))
    cut = F.when(F.length(summary) > 500, F.concat(F.regexp_replace(F.substring(summary, 1, 499), r"\s+\S*$", ""), F.lit("…"))).otherwise(summary)
    date = F.coalesce(*[V.iso(V.parse_time(V.Value("str", F.col(c).cast("string")))) for c in ("timestamp", "published_at", "date", "observed_at") if c in df.columns])
    return df.select("id", X.clean_title(F.col("title")).alias("title"), X.clean_link(F.col("link")).alias("link"), cut.alias("summary"), date.alias("date"))


def merged_history(new: DataFrame, old: DataFrame, most: int) -> DataFrame:
    """New items first, then old ones not among them, at most so many."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.join(new, "id", "left_anti").withColumn("_age", F.lit(1)))
    return both.orderBy("_age", F.desc("date"), "id").limit(most).drop("_age")


def rss(items: DataFrame, title: str, link: str) -> str:
    """A feed document of all its items, which merged_history bounds."""
    rows = items.withColumn("_t", F.to_timestamp("date")).toLocalIterator()
    body = "".join(f"<item><guid>{escape(r.id)}</guid><title>{escape(r.title or '')}</title><link>{escape(r.link or '')}</link><description>{escape(r.summary or '')}</description>" + (f"<pubDate>{format_datetime(r._t)}</pubDate>" if r._t else "") + "</item>" for r in rows)
    return f'<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link>{body}</channel></rss>'


def json_feed(items: DataFrame, title: str, link: str) -> str:
    """The same as a JSON feed."""
    rows = items.toLocalIterator()
    return json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": title, "home_page_url": link, "items": [{"id": r.id, "title": r.title, "url": r.link, "summary": r.summary, "date_published": r.date} for r in rows]}, ensure_ascii=False)


def atom(items: DataFrame, title: str, link: str) -> str:
    """The same as an Atom feed."""
    body = "".join(f"<entry><id>{escape(r.id)}</id><title>{escape(r.title or '')}</title><link href={quoteattr(r.link or '')}/><updated>{escape(r.date or '')}</updated><summary>{escape(r.summary or '')}</summary></entry>" for r in items.toLocalIterator())
    return f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{escape(title)}</title><id>{escape(link)}</id>{body}</feed>'


def pretty(df: DataFrame, most: int = 20) -> str:
    """The first rows for a reader: a title, then each field that has a value on a line of its own."""
    blocks = []
    for r in df.limit(most).collect():
        row = {k: v for k, v in r.asDict(recursive=True).items() if v is not None}
        head = row.pop("title", None) or row.get("key") or row.get("id") or ""
        blocks.append("\n".join([str(head), *(f"  {k}: {v}" for k, v in row.items())]))
    return "\n\n".join(blocks)


def insert_or_ignore(df: DataFrame, path: str, key: str = "id") -> None:
    """Append rows whose key the table lacks, one row for each key."""
    rest = [c for c in df.columns if c != key]
    new = df.groupBy(key).agg(F.min(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("_s"), F.first(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    try:
        new = new.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException:  # the table does not exist yet
        pass
    new.write.mode("append").parquet(path)


def messages(df: DataFrame, most: int, order: str) -> DataFrame:
    """The payloads that a webhook gets: the first `most` rows, and one summary of how many more there are."""
    text = F.concat_ws("\n", "title", "link")
    first = df.orderBy(order).limit(most).select(F.to_json(F.struct(text.alias("text"))).alias("payload"), F.lit(0).alias("last"))
    more = df.agg((F.count(F.lit(1)) - most).alias("n")).filter("n > 0").select(F.to_json(F.struct(F.concat(F.lit("and "), "n", F.lit(" more")).alias("text"))).alias("payload"), F.lit(1).alias("last"))
    return first.unionByName(more)


def post(df: DataFrame, url: str, most: int, order: str) -> int:
    n = 0
    for r in messages(df, most, order).orderBy("last").collect():  # most + 1 rows
        urllib.request.urlopen(urllib.request.Request(url, r.payload.encode(), {"Content-Type": "application/json"}), timeout=30).close()
        n += 1
    return n
