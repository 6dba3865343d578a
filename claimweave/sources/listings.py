"""Video feeds and listing pages as items: what is inside one payload, by SQL functions on its text or JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import text

# Where a listing page keeps its articles, and paths that are none.
LISTS = ("latestArticles", "moreInArticlesInitial", "authorFeedArticles")
NO_ARTICLE = r"^https?://[^/?#]*/(video|livecoverage)/"
_ROW = "array<struct<articleUrl:string,headline:string,isVideo:boolean,timestamp:string,summary:string,id:string,seoId:string>>"
WATCH = "https://www.youtube.com/watch?v="
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
_REFERENCE = r"^(lt|gt|quot|apos|amp|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"


def _character(number: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")


def unescaped(value: Column) -> Column:
    """The named and numbered characters that feeds escape, each once."""

    def one(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("long")
        character = F.when(F.startswith(name, F.lit("#")), _character(number)).otherwise(F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])[name])
        return F.when(at == 0, part).when(name == "", F.concat(F.lit("&"), part)).otherwise(F.concat(character, F.substring(part, F.length(name) + 2, F.length(part))))

    return F.array_join(F.transform(F.split(value, "&"), one), "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def _inner(block: Column, tag: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(block, f"(?s)<{tag}>(.*?)</{tag}>", 1), r"(?s)^<!\[CDATA\[|\]\]>$", ""))


def videos(xml: Column) -> Column:
    """array of (video_id, title, published, channel, url) of a video feed, in its order; entries without an id are left out."""

    def one(block: Column) -> Column:
        named = F.trim(F.regexp_extract(block, "(?s)<yt:videoId>(.*?)</yt:videoId>", 1))
        video = F.when(named != "", named).otherwise(F.regexp_extract(block, r"[?&]v=([A-Za-z0-9_-]+)", 1))
        title = unescaped(_inner(block, "title"))
        channel = unescaped(F.trim(F.regexp_extract(block, "(?s)<author>.*?<name>(.*?)</name>", 1)))
        published = F.left(F.regexp_extract(block, "(?s)<published>(.*?)</published>", 1), F.lit(10))
        titled = F.when(F.contains(block, F.lit("<title>")), title).otherwise(video)
        return F.struct(video.alias("video_id"), titled.alias("title"), published.alias("published"), channel.alias("channel"), F.concat(F.lit(WATCH), video).alias("url"))

    blocks = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit("(?s)<entry>(.*?)</entry>"), F.lit(1))
    return F.filter(F.transform(blocks, one), lambda v: v["video_id"] != "")


def feed_title(xml: Column) -> Column:
    """The title above a feed's first entry."""
    return unescaped(_inner(F.substring_index(F.coalesce(xml, F.lit("")), "<entry>", 1), "title"))


def listed(html: Column, site: str = "wsj.com") -> Column:
    """array of (title, link, date, summary, uid) of a listing page's articles, each link once.

    Videos, live pages, links to other sites and rows without title or link
    are left out; a page of another shape gives none.
    """
    data = F.regexp_extract(F.coalesce(html, F.lit("")), '(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    props = _once(data, lambda d: F.concat(*[F.coalesce(F.from_json(F.get_json_object(d, f"$.props.pageProps.{key}"), _ROW), F.array().cast(_ROW)) for key in LISTS]))
    link = lambda r: F.trim(F.coalesce(r["articleUrl"], F.lit("")))
    uid = lambda r: F.coalesce(F.nullif(r["id"], F.lit("")), F.nullif(r["seoId"], F.lit("")), link(r))
    here = lambda r: ~F.coalesce(r["isVideo"], F.lit(False)) & F.endswith(text.host_of(link(r)), F.lit(site)) & ~link(r).rlike(NO_ARTICLE)
    item = lambda r: F.struct(unescaped(F.trim(F.coalesce(r["headline"], F.lit("")))).alias("title"), link(r).alias("link"), text.date_of(F.coalesce(r["timestamp"], F.lit(""))).alias("date"), F.trim(F.coalesce(r["summary"], F.lit(""))).alias("summary"), uid(r).alias("uid"))
    good = F.filter(F.transform(F.filter(props, here), item), lambda i: i["title"] != "")
    return _once(good, lambda items: F.filter(items, lambda i, at: ~F.exists(F.slice(items, 1, at), lambda q: q["link"] == i["link"])))
