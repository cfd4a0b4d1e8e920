"""RSS, Atom and JSON feeds as entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

ENTRY = "struct<id:string,title:string,link:string,summary:string,published:string>"


def entries(df: DataFrame, body: str = "body") -> DataFrame:
    """feed bodies -> one row for each entry: key, title, link, summary, timestamp. The kind is told by the text itself."""
    b = F.col(body)
    items = F.transform(F.regexp_extract_all(b, F.lit(r"(?s)(<item[ >].*?</item>|<entry[ >].*?</entry>)"), 1), _entry)
    j = F.from_json(b, "struct<items:array<struct<id:string,title:string,url:string,summary:string,content_text:string,date_published:string>>>")
    of_json = F.transform(j["items"], lambda i: F.struct(i["id"].alias("id"), i["title"].alias("title"), i["url"].alias("link"), F.coalesce(i["summary"], i["content_text"]).alias("summary"), i["date_published"].alias("published")))
    rows = df.withColumn("_e", F.explode(F.when(F.ltrim(b).startswith("{"), of_json).otherwise(items)))
    e = F.col("_e")
    return rows.select(*[c for c in df.columns if c != body], F.coalesce(e["id"], e["link"], e["title"]).alias("key"), X.clean_title(e["title"]).alias("title"), X.clean_link(e["link"]).alias("link"), X.strip_html(X.unescape(e["summary"])).alias("summary"), V.iso(V.parse_time(V.Value("str", e["published"]))).alias("timestamp"))


def _entry(x):
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit("")) for n in names])
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract(x, r'<link[^>]*href="([^"]*)"', 1), F.lit("")))
    return F.struct(tag("guid", "id").alias("id"), tag("title").alias("title"), link.alias("link"), tag("description", "summary", "content").alias("summary"), tag("pubDate", "published", "updated").alias("published"))
