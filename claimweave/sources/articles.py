"""The article of a page: its own structured data, else a site's body element, else the element with most prose.

A page becomes a tree of elements in one Arrow function; what follows walks
that tree, without recursion, so pages may be long and deep. Everything is
decided within a page, so the work needs no shuffle.

Defined cases: a null page is empty. A page without a title is "untitled", one
without a date has an empty one, and one without prose has an empty body. Of
elements with equally much prose the first counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, those whose start ends a paragraph, what a repeated element ends, and what isn't prose.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_ITSELF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
HIDDEN = frozenset("script style template".split())
NO_PROSE = frozenset("script style noscript nav header footer aside form svg".split())
# Which elements hold the body, by site; each is (tag or none, conditions on attributes).
BODIES: dict[str, tuple[tuple[str, tuple[tuple[str, str, str], ...]], ...]] = {
    "ft.com": (("", (("class", "word", "article__content-body"),)), ("", (("id", "is", "article-body"),))),
    "wsj.com": (
        ("section", (("data-type", "is", "article-body"),)), ("article", (("style", "has", "article-body"),)), ("", (("data-type", "is", "article-body"),)),
        ("", (("class", "word", "article-content"),)), ("", (("class", "has", "ArticleBody"),)),
    ),
    "substack.com": (("", (("class", "word", "body"), ("class", "word", "markup"))), ("", (("class", "word", "available-content"),))),
}
ARTICLE_TYPES = ("NewsArticle", "Article", "BlogPosting", "Report")
NESTED = ("@graph", "mainEntity", "mainEntityOfPage")
#: Characters that a paragraph must exceed, and that a site's body must have.
PARAGRAPH, BODY = 40, 200


class Element:
    __slots__ = ("tag", "attrs", "inner", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inner: list[Element | str] = []

    def walk(self, without: frozenset[str] = frozenset()) -> Iterator[Element | str]:
        """Everything below, in page order; elements in ``without`` are left out with what they hold."""
        ahead = [iter(self.inner)]
        while ahead:
            for item in ahead[-1]:
                if isinstance(item, str):
                    yield item
                elif item.tag not in without:
                    yield item
                    ahead.append(iter(item.inner))
                    break
            else:
                ahead.pop()

    def every(self, tag: str, without: frozenset[str] = frozenset()) -> list[Element]:
        return [e for e in self.walk(without) if isinstance(e, Element) and e.tag == tag]

    def text(self, between: str, strip: bool = True, without: frozenset[str] = HIDDEN) -> str:
        pieces = [x for x in self.walk(without) if isinstance(x, str)]
        return between.join(p for p in (x.strip() for x in pieces) if p) if strip else between.join(pieces)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open, self.names = [self.root], Counter()

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.names[self.open.pop().tag] -= 1

    def _close(self, tag: str, within: tuple[str, ...]) -> None:
        """End the innermost open ``tag``, unless one of ``within`` was opened after it."""
        if self.names[tag]:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag == tag:
                    return self._close_to(depth)
                if self.open[depth].tag in within:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close("p", ("table", "td", "th", "caption", "button", "object"))
        if tag in ENDS_ITSELF:
            self._close(tag, ENDS_ITSELF[tag])
        here = self.open[-1]
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, here)
        here.inner.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, ())

    def handle_data(self, data: str) -> None:
        inner = self.open[-1].inner
        if inner and isinstance(inner[-1], str):
            inner[-1] += data
        else:
            inner.append(data)


def tree(html: str | None) -> Element:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def plain_text(html: str | None) -> str:
    """A fragment as paragraphs: those that are marked, else its lines."""
    left_out = frozenset(("script", "style", "noscript"))
    root = tree(html)
    paragraphs = [t for t in (p.text(" ", without=left_out) for p in root.every("p", left_out)) if t]
    return "\n\n".join(paragraphs or [t for t in (line.strip() for line in root.text("\n", False, left_out).split("\n")) if t])


def _tidy(raw: str) -> str:
    """Text that may be escaped HTML: white space squeezed, blank lines between paragraphs."""
    text = unescape(raw)
    if "<" in text and ">" in text:
        text = tree(text).text("\n", False)
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t\xa0]+", " ", text)).strip()


def _objects(data: object) -> Iterator[dict]:
    ahead = [data]
    while ahead:
        item = ahead.pop()
        if isinstance(item, list):
            ahead.extend(reversed(item))
        elif isinstance(item, dict):
            yield item
            ahead.extend(item[k] for k in reversed(NESTED) if k in item)


def _structured(root: Element) -> tuple[str, str, str] | None:
    """(headline, date, body) of the page's first article object that has a body."""
    for script in root.every("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(x for x in script.inner if isinstance(x, str)).strip())
        except (ValueError, RecursionError):
            continue
        for item in _objects(data):
            types = item.get("@type") or ""
            named = any(isinstance(t, str) and (t in ARTICLE_TYPES or t.endswith("Article")) for t in (types if isinstance(types, list) else [types]))
            body = item.get("articleBody") if named else None
            body = "\n\n".join(map(str, body)) if isinstance(body, list) else body
            if isinstance(body, str) and body.strip():
                return str(item.get("headline") or ""), str(item.get("datePublished") or ""), _tidy(body)
    return None


def _holds(element: Element, wanted: tuple[str, tuple[tuple[str, str, str], ...]]) -> bool:
    tag, conditions = wanted
    if tag and element.tag != tag:
        return False
    for name, how, value in conditions:
        has = element.attrs.get(name)
        if has is None or not (has == value if how == "is" else value in has if how == "has" else value in has.split()):
            return False
    return True


def _prose(container: Element) -> str:
    blocks = container.every("p", NO_PROSE) or [e for e in container.walk(NO_PROSE) if isinstance(e, Element) and e.attrs.get("data-type") == "paragraph"]
    long = [t for t in (b.text(" ", without=NO_PROSE) for b in blocks) if len(t) > PARAGRAPH]
    return "\n\n".join(long) if long else _tidy(container.text("\n", False, NO_PROSE))


def _body_of_site(root: Element, url: str) -> str:
    try:
        host = (urlsplit(url).hostname or "").lower().removeprefix("www.")
    except ValueError:
        host = ""
    mine = [s for s in BODIES if host == s or host.endswith("." + s)]
    elements = [e for e in root.walk(NO_PROSE) if isinstance(e, Element)]
    for site in [*mine, *[s for s in BODIES if s not in mine]]:
        for element in elements:
            if any(_holds(element, wanted) for wanted in BODIES[site]):
                body = _prose(element)
                if len(body) >= BODY:
                    return body
    return ""


def _densest(root: Element) -> Element:
    """The first article element, else the one whose own paragraphs have most text."""
    articles = root.every("article", NO_PROSE)
    if articles:
        return articles[0]
    lengths: dict[int, int] = {}
    holders: dict[int, Element] = {}
    for p in root.every("p", NO_PROSE):
        at = id(p.parent)
        holders.setdefault(at, p.parent)
        lengths[at] = lengths.get(at, 0) + len(p.text("", without=NO_PROSE))
    best = max(lengths.values(), default=0)
    return next((holders[k] for k, n in lengths.items() if n == best), root) if best else root


def read_article(html: str | None, url: str | None = "") -> tuple[str, str, str]:
    """(title, published, body) of a page."""
    root = tree(html)
    meta = root.every("meta")
    said = lambda name, value: next((m.attrs["content"] for m in meta if m.attrs.get(name) == value and m.attrs.get("content")), None)
    titles = root.every("title")
    title = said("property", "og:title") or (titles[0].text("") if titles else "untitled")
    published = said("property", "article:published_time") or said("name", "date") or ""
    structured = _structured(root)
    if structured:
        return structured[0] or title, structured[1] or published, structured[2]
    body = _body_of_site(root, url or "")
    if not body:
        body = "\n\n".join(t for t in (p.text(" ", without=NO_PROSE) for p in _densest(root).every("p", NO_PROSE)) if len(t) > PARAGRAPH)
    return title, published, body


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "published", "body")]))
def _articles(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_article(h, u) for h, u in zip(html, url, strict=True)], columns=["title", "published", "body"])


@F.pandas_udf(T.StringType())
def _texts(html: pd.Series) -> pd.Series:
    return html.map(plain_text)


def article(html: Column, url: Column) -> Column:
    """struct (title, published, body) of pages; the package must be with the workers (``importable_by_workers``)."""
    return _articles(F.coalesce(html, F.lit("")), F.coalesce(url, F.lit("")))


def html_text(html: Column) -> Column:
    return _texts(F.coalesce(html, F.lit("")))


def upload(path: Column, content: Column) -> Column:
    """The document that an uploaded file becomes: an article under its header, or the text as it is under the file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    raw = F.make_valid_utf8(content.cast("string"))
    web = F.lower(name).rlike(r"\.html?$")
    a = article(F.when(web, raw).otherwise(""), F.lit(""))
    written = F.concat(F.lit("# title: "), a["title"], F.lit("\n# source_type: article\n# published: "), F.left(a["published"], F.lit(10)), F.lit("\n---\n"), a["body"], F.lit("\n"))
    return F.when(web, written).otherwise(F.concat(F.lit("# title: "), stem, F.lit("\n# source_type: document\n---\n"), raw, F.lit("\n")))
