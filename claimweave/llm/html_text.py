"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to a tree of block elements. Each node has features of
its subtree (text, link density, share of the page, tags), of its attribute
tokens, its depth and its siblings. Boosted trees score how likely the
node's text is main text, and decoding from the root down makes ancestors
and descendants agree: a subtree is cut out as a whole or kept, and its
children can only be cut out of a kept one.

The trees are fitted on pages that are built from sampled sentences of the
table (at most ``SAMPLE`` pages) in generated layouts, where each block's
role is known: articles in many wrappings, and menus, headers, footers,
sidebars, notices, adverts, forms and comments.

Text is decoded as HTML: references are decoded, white space within a block
becomes one space, blocks are trimmed and joined by one space in page
order. Scripts, styles and comments have no text.

Defined cases: null and empty pages give the empty text, a page without
tags is one block. Any other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import boosting
from claimweave.llm.sampling import first_by_hash
from claimweave.llm.tables import in_workers, table

#: Pages whose sentences fill the generated ones, generated pages, and characters of a page that are cut into sentences.
SAMPLE, GENERATED = 60, 700

# Fixed names of HTML: elements without content, without text, that end an open paragraph, and that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript title head svg math iframe object canvas textarea select option datalist".split())
BLOCKS = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label legend".split())
_CLOSES_P = BLOCKS - {"html", "body", "button", "label", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: Tokens of class, id and role that tell what a block is for.
GOOD_TOKENS = frozenset("article post entry story content main body text richtext prose blog page".split())
BAD_TOKENS = {
    "menu": frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs links linklist".split()),
    "frame": frozenset("header masthead banner topbar logo footer foot copyright legal bottom colophon".split()),
    "side": frozenset("sidebar side aside rail widget related recommended popular trending tags share social author bio".split()),
    "advert": frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion dfp teaser".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall message".split()),
    "comments": frozenset("comment comments commentlist reply replies respond discussion disqus reader feedback review reviews".split()),
}
_TAGS = {
    "good": frozenset({"article", "main"}), "menu": frozenset({"nav", "menu"}), "frame": frozenset({"header", "footer"}), "side": frozenset({"aside", "dialog"}),
    "form": frozenset({"form", "fieldset", "button", "label", "legend"}), "list": frozenset({"ul", "ol", "dl"}), "item": frozenset({"li", "dd", "dt"}),
    "text": frozenset({"p", "pre", "blockquote"}), "heading": frozenset({"h1", "h2", "h3", "h4", "h5", "h6"}), "box": frozenset({"div", "section"}),
    "table": frozenset({"table", "tr", "td", "th", "tbody"}), "figure": frozenset({"figure", "figcaption"}),
}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "pieces", "role", "chars", "link_chars", "blocks", "links", "depth", "stops")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Node | None, role: int | None = None):
        self.tag, self.tokens, self.parent, self.role = tag, tokens, parent, role
        self.children: list[Node] = []
        self.pieces: list[str | Node] = []  # text and block children, in order
        self.chars = self.link_chars = self.blocks = self.links = self.stops = 0
        self.depth = parent.depth + 1 if parent else 0


class _Builder(HTMLParser):
    """Builds the tree of block elements; inline elements only add their text to the block that they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.node = Node("html", frozenset(), None)
        self.open: list[tuple[str, Node | None]] = []  # open elements, with the node of those that are blocks
        self.silent = 0
        self.anchors = 0

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, node = self.open.pop()
            if node is not None:
                self.node = node.parent or self.root
            if tag in SILENT:
                self.silent -= 1
            if tag == "a":
                self.anchors -= 1

    def _close(self, tags: set[str], stop: frozenset[str] | set[str]) -> None:
        for i in range(len(self.open) - 1, max(len(self.open) - 40, -1), -1):
            tag = self.open[i][0]
            if tag in tags:
                self._pop(i)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br" or tag == "hr":
            self.node.pieces.append(" ")
        if tag in VOID:
            return
        if tag in _CLOSES_P:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in _SAME_CLOSES:
            self._close(_SAME_CLOSES[tag], _SCOPE.get(tag, set()))
        if tag in SILENT:
            self.silent += 1
        node = None
        if tag in BLOCKS and not self.silent:
            named = dict(attrs)
            raw = " ".join(str(named.get(k) or "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower()
            role = named.get("data-role-known")
            node = Node(tag, frozenset(_SPLIT.split(raw)) - {""}, self.node, int(role) if role in ("0", "1") else None)
            self.node.children.append(node)
            self.node.pieces.append(node)
            self.node = node
        if tag == "a":
            self.anchors += 1
            self.node.links += 1
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            # An inline element's end doesn't close blocks around it.
            if self.open[i][1] is not None and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.node.pieces.append(data)
        n = len(data) - data.count(" ")
        self.node.chars += n
        self.node.stops += data.count(". ") + data.count("? ") + data.count("! ")
        if self.anchors:
            self.node.link_chars += n

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def parse_marked_section(self, i: int, report: bool = True) -> int:  # noqa: FBT001, FBT002
        """Marked sections are bogus comments in HTML."""
        return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        """Marked sections have no text."""


def parse(html: str) -> Node:
    """The tree of a page's blocks, with sums over subtrees."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    order, stack = [], [builder.root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    for node in reversed(order):
        node.blocks = 1 + sum(c.blocks for c in node.children)
        node.chars += sum(c.chars for c in node.children)
        node.link_chars += sum(c.link_chars for c in node.children)
        node.links += sum(c.links for c in node.children)
        node.stops += sum(c.stops for c in node.children)
    return builder.root


def nodes_of(root: Node) -> list[Node]:
    """All nodes but the root, parents first, in page order."""
    out, stack = [], list(reversed(root.children))
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


_KINDS, _BAD = list(_TAGS), list(BAD_TOKENS)
_NO_TOKENS = [0.0] * (len(_BAD) + 1)


@lru_cache(maxsize=256)
def _tag_features(tag: str) -> tuple[list[float], tuple[float, ...]]:
    """One for the kind of the tag; and what it says of all below: menu, frame, side, main text."""
    own = [float(tag in _TAGS[k]) for k in _KINDS]
    return own, tuple(float(tag in _TAGS[k]) for k in ("menu", "frame", "side", "good"))


@lru_cache(maxsize=4096)
def _token_features(tokens: frozenset[str]) -> list[float]:
    return [*(float(bool(tokens & BAD_TOKENS[k])) for k in _BAD), float(bool(tokens & GOOD_TOKENS))]


def features(nodes: list[Node], root: Node) -> np.ndarray:
    """Features of every node: what ancestors' tags and tokens say, its own, its subtree's density, depth and siblings."""
    total, rows, counts = root.chars + 1, [], []
    inside: dict[int, tuple[float, ...]] = {id(root): (0.0,) * (len(_BAD) + 4)}
    many: dict[int, tuple[int, float]] = {}
    place: dict[int, int] = {}
    for node in (root, *nodes):
        paragraphs = 0
        for i, c in enumerate(node.children):
            place[id(c)] = i
            paragraphs += c.tag == "p"
        n = len(node.children)
        many[id(node)] = (n, paragraphs)
    for node in nodes:
        parent = node.parent
        above = inside[id(parent)]
        tags, says = _tag_features(node.tag)
        tokens = _token_features(node.tokens) if node.tokens else _NO_TOKENS
        if node.children:
            own = (*tokens[:-1], *says[:-1], max(tokens[-1], says[-1]))
            inside[id(node)] = tuple(map(max, above, own)) if any(own) else above
        rows.append((*tokens, *tags, *above))
        siblings, paragraphs = many[id(parent)]
        children, below = many[id(node)]
        counts.append((node.chars, node.link_chars, node.blocks, node.links, node.stops, node.depth, place[id(node)], siblings, parent.chars, paragraphs, children, below))
    c = np.array(counts, dtype=np.float32).reshape(len(nodes), 12).T
    chars, links = c[0], c[1]
    numbers = [np.log1p(chars), chars / total, links / (chars + 1), chars / c[2], np.log1p(c[3]), c[4] / (chars + 1) * 100, np.log1p(c[2]), c[5], c[6] / c[7], np.log1p(c[7]), chars / (c[8] + 1), c[9] / c[7], c[11] / (c[10] + 1)]
    return np.concatenate([np.array(rows, dtype=np.float32), np.stack(numbers, 1)], 1)


def decode(root: Node, kept: dict[int, float]) -> str:
    """Text of what is kept: from the root down, a node cut out takes its subtree along."""
    parts: list[str] = []
    run: list[str] = []

    def flush() -> None:
        words = " ".join("".join(run).split())
        if words:
            parts.append(words)
        run.clear()

    whole = not root.children
    stack: list[object] = [*reversed(root.pieces)] if whole or any(isinstance(p, str) and p.strip() for p in root.pieces) else [p for p in reversed(root.pieces) if not isinstance(p, str)]
    while stack:
        piece = stack.pop()
        if isinstance(piece, str):
            run.append(piece)
        elif piece is None:
            flush()
        else:
            flush()
            if kept[id(piece)] > 0:
                stack.append(None)
                stack.extend(reversed(piece.pieces))
    flush()
    return " ".join(parts)


def extract_all(pages: list[str | None], model: boosting.Trees) -> list[str]:
    """The main text of each page; the nodes of all pages are scored together."""
    roots = [parse(h or "") for h in pages]
    nodes = [nodes_of(r) for r in roots]
    some = [features(n, r) for n, r in zip(nodes, roots, strict=True) if n]
    logit = model.logit(np.concatenate(some)).tolist() if some else []
    out, at = [], 0
    for root, own in zip(roots, nodes, strict=True):
        out.append(decode(root, dict(zip(map(id, own), logit[at : at + len(own)], strict=True))))
        at += len(own)
    return out


# Generated pages ---------------------------------------------------------


def _attribute(rng: random.Random, tokens: list[str]) -> str:
    if not tokens or rng.random() < 0.12:
        return ""
    name = rng.choice(tokens)
    form = rng.choice(["{}", "{}-box", "site-{}", "{}_1", "js-{} block", "{}-wrapper", "c-{}"])
    return f' {rng.choice(["class", "id"])}="{form.format(name)}"'


def generate(sentences: list[str], seed: int) -> str:
    """A page whose blocks carry ``data-role-known``: 1 for main text, 0 for all else."""
    rng = random.Random(seed)
    say = lambda a, b: " ".join(rng.choice(sentences) for _ in range(rng.randint(a, b)))
    short = lambda: " ".join(rng.choice(sentences).split()[: rng.randint(1, 4)])

    def block(tag: str, inner: str, role: int, tokens: list[str] | None = None) -> str:
        return f'<{tag} data-role-known="{role}"{_attribute(rng, tokens or [])}>{inner}</{tag}>'

    def menu() -> str:
        items = "".join(block("li", f'<a href="/{i}">{short()}</a>', 0) for i in range(rng.randint(3, 12)))
        inner = block("ul", items, 0)
        return block("nav", inner, 0, [*BAD_TOKENS["menu"], ""]) if rng.random() < 0.6 else block("div", inner, 0, sorted(BAD_TOKENS["menu"]))

    def plain(kind: str, tags: list[str], least: int, most: int) -> str:
        body = say(least, most)
        inner = rng.choice([body, block("p", body, 0), block("h3", short(), 0) + block("p", body, 0), block("p", body, 0) + block("ul", "".join(block("li", f'<a href="#">{short()}</a>', 0) for _ in range(3)), 0)])
        tag = rng.choice(tags)
        tokens = sorted(BAD_TOKENS[kind])
        found = block(tag, inner, 0, tokens)
        # A plain box must be named, or nothing tells it from text.
        return found if tag not in ("div", "section") or any(t in found.split(">")[0] for t in tokens) else f'<div data-role-known="0" class="{rng.choice(tokens)}">{inner}</div>'

    def form() -> str:
        return block("form", f'{block("label", short(), 0)}<input name="q">{block("button", short(), 0)}', 0, ["search", "login", "newsletter", "contact"])

    def comments() -> str:
        each = lambda: block(rng.choice(["div", "li", "article"]), block("p", short(), 0) + block("p", say(1, 4), 0), 0, ["comment", "reply"])
        inner = block("h3", short(), 0) + "".join(each() for _ in range(rng.randint(1, 6)))
        return f'<{(tag := rng.choice(["div", "section", "ol", "aside"]))} data-role-known="0" {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "reader-comments", "respond"])}">{inner}</{tag}>'

    def article() -> str:
        parts = [block("h1", short() + " " + short(), 1)] if rng.random() < 0.8 else []
        tiny = rng.random() < 0.2  # a few words in all
        for _ in range(rng.randint(1, 2 if tiny else 12)):
            kind = rng.random()
            text = short() if tiny else say(1, 6)
            if rng.random() < 0.2:
                text = f'<b>{text}</b><br>{say(1, 2)} <a href="/x">{short()}</a>'
            if kind < 0.75:
                parts.append(block("p", text, 1))
            elif kind < 0.82:
                parts.append(block(rng.choice(["h2", "h3"]), short(), 1))
            elif kind < 0.88:
                parts.append(block("blockquote", block("p", text, 1), 1))
            elif kind < 0.93:
                parts.append(block("ul", "".join(block("li", say(1, 1), 1) for _ in range(rng.randint(2, 5))), 1))
            elif kind < 0.96:
                parts.append(block("table", block("tr", block("td", short(), 1) + block("td", short(), 1), 1), 1))
            else:
                parts.append(block("div", text, 1))
        for make in rng.sample([lambda: plain("advert", ["div", "aside", "section"], 1, 3), comments, lambda: plain("notice", ["div", "aside"], 1, 2), lambda: plain("side", ["aside", "div"], 1, 3), form], rng.choice([0, 0, 0, 1, 2])):
            parts.insert(rng.randint(1, len(parts)), make())
        inner = "".join(parts)
        tag = rng.choice(["article", "article", "main", "div", "section"])
        return block(tag, inner, 1, sorted(GOOD_TOKENS) if tag in ("div", "section") or rng.random() < 0.3 else [])

    middle = article()
    for _ in range(rng.choice([0, 0, 1, 2])):
        middle = block(rng.choice(["div", "section", "main"]), middle + (rng.choice([comments, menu, form])() if rng.random() < 0.3 else ""), 1, ["wrapper", "container", "content", "main", "page", "row", "col"])
    top = [menu] if rng.random() < 0.8 else []
    top += rng.sample([lambda: plain("frame", ["header"], 1, 2), lambda: plain("advert", ["div", "section", "aside"], 1, 4), lambda: plain("notice", ["div", "section", "dialog"], 1, 3), form], rng.randint(0, 3))
    end = rng.sample([lambda: plain("side", ["aside", "div"], 1, 6), comments, lambda: plain("advert", ["div", "aside"], 1, 4), menu, form, lambda: plain("notice", ["div"], 1, 3)], rng.randint(0, 3))
    foot = [lambda: plain("frame", ["footer", "footer", "div"], 1, 3)] if rng.random() < 0.9 else []
    rng.shuffle(top)
    return f"<html><body>{''.join(make() for make in top)}{middle}{''.join(make() for make in [*end, *foot])}</body></html>"


def fit(sentences: list[str], pages: int = GENERATED) -> boosting.Trees:
    """Trees for generated pages."""
    xs, ys = [], []
    for seed in range(pages):
        root = parse(generate(sentences, seed))
        nodes = nodes_of(root)
        xs.append(features(nodes, root))
        ys.append(np.array([n.role for n in nodes], dtype=float))
    return boosting.fit(np.concatenate(xs), np.concatenate(ys))


def sample_sentences(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> list[str]:
    """Sentences of a bounded sample of pages, a thousand at most; made-up words if there are none."""
    out: list[str] = []
    ids = first_by_hash(pages.select(id_col), SAMPLE, id_col).distinct()
    for row in pages.join(F.broadcast(ids), id_col, "left_semi").select(html_col).collect():
        for node in nodes_of(parse(row[html_col] or "")):
            if node.tag == "p":
                out += [s.strip() + "." for s in "".join(p for p in node.pieces if isinstance(p, str)).split(".")[:6] if s.strip()]
    escaped = [s.replace("&", "&amp;").replace("<", "&lt;") for s in out[:1000]]
    return escaped or ["Some words of text.", "Others follow here, in a longer line of words.", "And more."]


def extract_pages(pages: DataFrame, model: boosting.Trees, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and text of every page; the trees, of fixed size, are broadcast."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, texts, at = batch.column(1).to_pylist(), [], 0
            while at < len(htmls):  # some pages at a time: the trees of many need memory
                end, chars = at, 0
                while end < len(htmls) and end < at + 128 and (end == at or chars < 1 << 22):
                    chars += len(htmls[end] or "")
                    end += 1
                texts += extract_all(htmls[at:end], sent.value)
                at = end
            kept = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array(texts, pa.string())], [id_col, *rest, "text"])

    rest = [c for c in ("url",) if c in pages.columns]
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *rest))
    return in_workers(pages.select(id_col, html_col, *rest), run, f"{schema}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = fit(sample_sentences(pages))
    return extract_pages(pages, model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
