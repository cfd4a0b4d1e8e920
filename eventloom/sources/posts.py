"""Posts, videos, releases and issues: API payloads (VARIANT or JSON text) as one shape for each kind.

A kind is a table of output columns and the JSON paths that may hold them; Catalyst prunes what is not asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import values as V


def _get(p: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(p, "$." + path, kind)


def _any(*paths: str, kind: str = "string"):
    return lambda p: F.coalesce(*[_get(p, x, kind) for x in paths]) if len(paths) > 1 else _get(p, paths[0], kind)


def _int(path: str):
    return _any(path, kind="bigint")


def _names(path: str, field: str, prefix: str = ""):
    """One field of every object in a list."""
    return lambda p: F.transform(F.filter(F.coalesce(_get(p, path, f"array<struct<{field}:string>>"), F.array().cast(f"array<struct<{field}:string>>")), lambda x: x[field].isNotNull()), lambda x: F.concat(F.lit(prefix), x[field]))


def _join(prefix: str, *parts):
    return lambda p: reduce(lambda a, b: F.concat(a, b), [F.lit(prefix), *[x(p) if callable(x) else F.lit(x) for x in parts]])


_head = lambda path: lambda p: X.headline(F.coalesce(_get(p, path), F.lit("")))
_plain = lambda path: lambda p: X.strip_html(F.coalesce(_get(p, path), F.lit("")))

_BSKY = "app.bsky.feed.post"

#: kind -> (type, key, time, columns)
KINDS = {
    "release": ("release", _any("html_url", "id"), _any("published_at"), {
        "title": _any("name", "tag_name"), "tag": _any("tag_name"), "url": _any("html_url"), "prerelease": _any("prerelease", kind="boolean"), "author": _any("author.login"),
        "summary": _plain("body"), "assets": lambda p: F.coalesce(F.size(_get(p, "assets", "array<variant>")), F.lit(0))}),
    "repository": ("repository", _any("html_url"), _any("pushed_at"), {
        "title": _any("full_name"), "description": _any("description"), "url": _any("html_url"), "stars": _int("stargazers_count"), "forks": _int("forks_count"), "open_issues": _int("open_issues_count"),
        "language": _any("language"), "license": _any("license.spdx_id"), "topics": _any("topics", kind="array<string>"), "archived": _any("archived", kind="boolean")}),
    "tag": ("tag", _any("name"), _any("commit.date"), {"title": _any("name"), "sha": _any("commit.sha")}),
    "commit": ("commit", _any("html_url", "sha"), _any("commit.author.date"), {
        "title": lambda p: F.split_part(_get(p, "commit.message"), F.lit("\n"), F.lit(1)), "sha": _any("sha"), "url": _any("html_url"), "author": _any("author.login", "commit.author.name")}),
    "issue": ("issue", _any("html_url", "id"), _any("created_at"), {
        "title": _any("title"), "number": _int("number"), "url": _any("html_url"), "state": _any("state"), "author": _any("user.login"), "labels": _names("labels", "name"), "comments": _int("comments"),
        "pull_request": lambda p: _get(p, "pull_request", "variant").isNotNull()}),
    "mastodon": ("post", _any("reblog.url", "url", "uri"), _any("reblog.created_at", "created_at"), {
        "title": lambda p: X.headline(X.strip_html(_any("reblog.content", "content")(p))), "text": lambda p: X.strip_html(_any("reblog.content", "content")(p)), "author": _any("reblog.account.acct", "account.acct"),
        "url": _any("reblog.url", "url", "uri"), "language": _any("reblog.language", "language"), "tags": _names("tags", "name", "#"), "likes": _any("reblog.favourites_count", "favourites_count", kind="bigint"),
        "reposts": _any("reblog.reblogs_count", "reblogs_count", kind="bigint"), "replies": _any("reblog.replies_count", "replies_count", kind="bigint"), "shared_by": lambda p: F.when(_get(p, "reblog.url").isNotNull(), _get(p, "account.acct"))}),
    "reddit": ("post", _join("https://www.reddit.com", _any("permalink")), _any("created_utc"), {
        "title": _any("title"), "text": lambda p: F.concat_ws("\n", _get(p, "title"), F.nullif(F.substring(_get(p, "selftext"), 1, 2000), F.lit(""))), "author": _join("u/", _any("author")), "subreddit": _any("subreddit_name_prefixed"),
        "url": _join("https://www.reddit.com", _any("permalink")), "score": _int("score"), "comments": _int("num_comments"), "flair": _any("link_flair_text"),
        "links": lambda p: F.when(~F.coalesce(_get(p, "is_self", "boolean"), F.lit(False)), F.array(_get(p, "url"))).otherwise(F.array().cast("array<string>"))}),
    "x": ("post", _join("https://x.com/", lambda p: F.coalesce(_get(p, "user.username"), F.lit("i")), "/status/", _any("id")), _any("created_at"), {
        "title": _head("text"), "text": _any("text"), "author": _join("@", _any("user.username")), "language": _any("lang"), "tags": _names("entities.hashtags", "tag", "#"), "likes": _int("public_metrics.like_count"),
        "reposts": _int("public_metrics.retweet_count"), "replies": _int("public_metrics.reply_count")}),
    "youtube": ("video", _join("https://www.youtube.com/watch?v=", _any("id.videoId", "snippet.resourceId.videoId")), _any("snippet.publishedAt"), {
        "title": _any("snippet.title"), "summary": lambda p: F.nullif(F.substring(_get(p, "snippet.description"), 1, 500), F.lit("")), "channel": _any("snippet.channelTitle"), "video_id": _any("id.videoId", "snippet.resourceId.videoId")}),
    "bluesky": ("post", _join("at://", _any("did"), f"/{_BSKY}/", _any("commit.rkey")), _any("time_us"), {
        "text": lambda p: F.coalesce(_get(p, "commit.record.text"), F.lit("")), "langs": lambda p: F.transform(F.coalesce(_get(p, "commit.record.langs", "array<string>"), F.array().cast("array<string>")), F.lower),
        "url": _join("https://bsky.app/profile/", _any("did"), "/post/", _any("commit.rkey")), "reply": lambda p: _get(p, "commit.record.reply", "variant").isNotNull(), "created_at": _any("commit.record.createdAt"), "did": _any("did")}),
    "telegram": ("post", _any("url", "link"), _any("date", "datetime"), {"title": lambda p: X.headline(X.strip_html(_get(p, "text"))), "text": _plain("text"), "channel": _any("channel"), "url": _any("url", "link"), "views": _int("views")}),
}


def shaped(df: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """type, key, timestamp and the kind's columns; rows without a key go."""
    type_, key, time, cols = KINDS[kind]
    p = F.col(payload) if isinstance(df.schema[payload].dataType, T.VariantType) else F.try_parse_json(payload)
    rows = df.select(p.alias("_p"))
    p = F.col("_p")
    out = rows.select(F.lit(type_).alias("type"), key(p).alias("key"), V.iso(V.parse_time(V.Value("str", time(p)))).alias("timestamp"), *[f(p).alias(n) for n, f in cols.items()])
    return out.filter("key is not null")


def jetstream(df: DataFrame, words: list[str] = (), langs: list[str] = (), replies: bool = False, salt: str = "", payload: str = "payload") -> DataFrame:
    """New posts of a message stream, batch or streaming: by words (whole, any case) and languages, with an opaque author key
    so that people can be counted and not posts."""
    p = F.col(payload) if isinstance(df.schema[payload].dataType, T.VariantType) else F.try_parse_json(payload)
    made = df.withColumn(payload, p).filter((_get(F.col(payload), "kind") == "commit") & (_get(F.col(payload), "commit.operation") == "create") & (_get(F.col(payload), "commit.collection") == _BSKY))
    out = shaped(made, "bluesky", payload)
    if not replies:
        out = out.filter(~F.col("reply"))
    if langs:
        out = out.filter(F.exists("langs", lambda x: F.split_part(x, F.lit("-"), F.lit(1)).isin(*langs)))
    if words:
        import re

        out = out.filter(F.col("text").rlike(r"(?iU)(?<!\w)(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words) + r")(?!\w)"))
    tags = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\w#])(#[A-Za-z_]\w{1,49})"), 1), F.lower))
    return out.withColumns({"tags": tags, "author_key": F.substring(F.sha2(F.concat(F.lit(salt), "did"), 256), 1, 16)}).drop("did")
