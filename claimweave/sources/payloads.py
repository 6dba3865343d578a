"""Fetched payloads to rows: feeds, filings, captions, posts, listings, pages and registers.

Payload columns hold what a fetcher stored; nothing here fetches. Feeds and
pages are read with patterns, JSON with explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILINGS = "struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,items:array<string>>>"
CAPTIONS = "struct<events:array<struct<segs:array<struct<utf8:string>>>>>"
POSTS = "array<struct<id:string,account:string,text:string,urls:array<struct<short:string,expanded:string>>>>"
BRIDGE = "struct<items:array<struct<title:string,url:string,date_published:string,content_text:string,authors:array<struct<name:string>>>>>"
#: Shares of a counted text, and characters, under which a paid post is a preview.
PREVIEW_SHARE, PREVIEW_CHARS, THIN_CHARS = 0.8, 1500, 400


def unescape(text: Column) -> Column:
    """The references that feeds use, and CDATA marks."""
    out = F.regexp_replace(text, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def tag(xml: Column, name: str) -> Column:
    """The text of the first element of this name; null if there is none or it is empty."""
    return F.nullif(unescape(F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)), F.lit(""))


def feed_items(feeds: DataFrame, payload: str, *keep: str) -> DataFrame:
    """title, link, date, content, enclosure and uid of RSS items and Atom entries; items without title or link go."""
    item = F.explode(F.regexp_extract_all(payload, F.lit(r"(?s)<(?:item|entry)(?:\s[^>]*)?>.*?</(?:item|entry)>"), F.lit(0))).alias("_item")
    x = F.col("_item")
    href = F.nullif(F.regexp_extract(x, r'<link[^>]*\shref="([^"]*)"', 1), F.lit(""))
    out = feeds.select(*keep, item).select(
        *keep, tag(x, "title").alias("title"), F.coalesce(tag(x, "link"), href).alias("link"),
        F.coalesce(tag(x, "pubDate"), tag(x, "published"), tag(x, "updated")).alias("date"),
        F.coalesce(tag(x, "content:encoded"), tag(x, "content"), tag(x, "description"), tag(x, "summary")).alias("content"),
        F.nullif(F.regexp_extract(x, r'<enclosure[^>]*\surl="([^"]*)"', 1), F.lit("")).alias("enclosure"),
        F.coalesce(tag(x, "guid"), tag(x, "id")).alias("uid"),
    )
    return out.filter("title is not null and link is not null")


def unseen(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Items whose key no event has."""
    return items.join(known.select(key), key, "left_anti")


def filings(payloads: DataFrame, payload: str, form: str, most: int, *keep: str) -> DataFrame:
    """The first ``most`` filings of a form for each company, from parallel arrays in order."""
    recent = F.from_json(payload, FILINGS)["recent"]
    zipped = F.arrays_zip(recent["accessionNumber"].alias("accession"), recent["form"].alias("form"), recent["filingDate"].alias("filed"), recent["items"].alias("items"))
    rows = payloads.select(*keep, F.filter(zipped, lambda z: z["form"] == form).alias("z"))
    return rows.select(*keep, F.posexplode(F.slice("z", 1, most)).alias("at", "f")).select(*keep, "at", "f.accession", "f.filed", "f.items")


def caption_text(payload: Column) -> Column:
    events = F.from_json(payload, CAPTIONS)["events"]
    parts = F.flatten(F.transform(events, lambda e: F.coalesce(F.transform(e["segs"], lambda s: s["utf8"]), F.array().cast("array<string>"))))
    return F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s+", " "))


def posts_by_account(payloads: DataFrame, payload: str, since: Column) -> DataFrame:
    """One document for each account of posts after ``since``, in order of zero-padded ids, with the new cursor; short URLs expanded."""
    post = payloads.select(F.explode(F.from_json(payload, POSTS)).alias("p")).select("p.*").withColumn("key", F.lpad("id", 24, "0")).filter(F.col("key") > F.lpad(since, 24, "0"))
    expanded = F.aggregate(F.coalesce("urls", F.array().cast("array<struct<short:string,expanded:string>>")), F.col("text"), lambda acc, u: F.replace(acc, u["short"], u["expanded"]))
    listed = F.array_sort(F.collect_list(F.struct("key", F.col("_text").alias("t"))))
    return post.withColumn("_text", expanded).groupBy("account").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("document"), F.max("key").alias("_last"), F.count(F.lit(1)).alias("posts")).withColumn("cursor", F.regexp_replace("_last", "^0+", "")).drop("_last")


def bridge_items(payloads: DataFrame, payload: str, *keep: str) -> DataFrame:
    item = F.explode(F.from_json(payload, BRIDGE)["items"]).alias("i")
    return payloads.select(*keep, item).select(*keep, F.col("i.title").alias("title"), F.col("i.url").alias("url"), F.col("i.date_published").alias("date"), F.col("i.content_text").alias("content"), F.element_at("i.authors", 1)["name"].alias("author"))


def is_preview(body: Column, word_count: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(body), r"\s+"), lambda w: w != ""))
    return F.when(word_count.isNotNull(), words < word_count * PREVIEW_SHARE).otherwise(F.length(body) < PREVIEW_CHARS)


def article(html: Column) -> Column:
    """title and body (paragraphs over 40 characters, joined by blank lines) of a page, by patterns."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", " ")
    inside = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit("")), bare)
    plain = lambda c: unescape(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    paragraphs = F.transform(F.regexp_extract_all(inside, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b)"), F.lit(1)), plain)
    return F.struct(plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("title"), F.array_join(F.filter(paragraphs, lambda p: F.length(p) > 40), "\n\n").alias("body"))


def is_article(html: Column) -> Column:
    """An og:type or JSON-LD article, or an <article> with more than 1500 characters of paragraphs."""
    said = html.rlike(r'(?i)<meta[^>]*property="og:type"[^>]*content="article"|"@type"\s*:\s*"(?:News)?Article"')
    paragraphs = F.regexp_extract_all(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b)"), F.lit(1))
    chars = F.aggregate(paragraphs, F.lit(0), lambda acc, p: acc + F.length(F.regexp_replace(p, r"<[^>]*>", "")))
    return said | (chars > 1500)


# Where a URL goes, first match first.
ROUTES = (
    ("youtube_video", r"^https?://(?:[a-z]+\.)?youtube\.com/watch\?|^https?://youtu\.be/"),
    ("youtube_channel", r"^https?://(?:[a-z]+\.)?youtube\.com/(?:@|channel/|c/|user/)"),
    ("x_post", r"^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/[^/]+/status/[0-9]+"),
    ("x_account", r"^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/[^/]+$"),
    ("substack_post", r"^https?://[^/]+\.substack\.com/p/"),
    ("substack", r"^https?://[^/]+\.substack\.com"),
    ("feed", r"(?:/feed|/rss|\.xml|\.rss|\.atom)$"),
    ("file", r"\.pdf$"),
)


def route(url: Column) -> Column:
    """What kind of source a normalised URL is; any other is an article, '' is invalid."""
    out = F.when(url == "", "invalid")
    for kind, pattern in ROUTES:
        out = out.when(url.rlike(pattern), kind)
    return out.otherwise("article")


def long_names(register: DataFrame, identifier: str, legal: str, others: str) -> DataFrame:
    """A row for each legal name and each other name of a register, as gathered from its wide rows."""
    one = F.array(F.struct(F.col(legal).alias("name"), F.lit(False).alias("is_alt")))
    rest = F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(True).alias("is_alt")))
    return register.select(identifier, F.explode(F.concat(one, rest)).alias("n")).select(identifier, "n.name", "n.is_alt").filter("name is not null")


def newest(items: DataFrame, source: str, date: str, tie: str, most: int) -> DataFrame:
    """The newest items of each source."""
    by = Window.partitionBy(source).orderBy(F.col(date).desc_nulls_last(), tie)
    return items.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")
