"""Current reports of watched companies: which are new, their main document and press exhibits, as one document under a header.

Fetched payloads are tables: a company's submissions as JSON of parallel
arrays, and pages by address. Companies, filings, pages and known filings
meet in joins; only what is inside one page is read by an Arrow function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.sources.articles import Element, tree

#: Form that is read, filings of a company in one poll, exhibits of a filing, characters of a document.
FORM, NEWEST, EXHIBITS, LONGEST = "8-K", 2, 3, 80_000
SUBMISSIONS = "struct<filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,primaryDocument:array<string>,items:array<string>>>>"
#: What separates an exhibit from what is above it.
RULE = "---- EXHIBIT {} ----\n\n"


def page_text(html: str | None) -> str:
    """All text of a filing's page but scripts and styles; blanks squeezed, one blank line at most."""
    text = tree(html).text("\n", False, frozenset(("script", "style")))
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t\xa0]+", " ", text)).strip()


def _is_page(name: str) -> bool:
    return name.lower().endswith((".htm", ".html"))


def exhibit_names(index_html: str | None, index_json: str | None) -> list[str]:
    """Names of the press exhibits: by the type column of the index page, else by file names of the index."""
    names = []
    for row in tree(index_html).every("tr"):
        cells = [c.text("") for c in row.every("td")]
        link = next((a for a in row.walk() if isinstance(a, Element) and a.tag == "a" and "href" in a.attrs), None)
        if len(cells) >= 4 and link is not None and any(c.upper().startswith("EX-99") for c in cells):
            name = link.attrs["href"].split("doc=")[-1].split("/")[-1] if "ix?doc=" in link.attrs["href"] else link.attrs["href"].split("/")[-1]
            names += [name] if _is_page(name) else []
    if not names:
        try:
            listed = [str(item["name"]) for item in json.loads(index_json or "")["directory"]["item"]]
        except (ValueError, KeyError, TypeError):
            listed = []
        names = [n for n in listed if re.search("ex[-_]?99", n, re.I) and _is_page(n)]
    return names[:EXHIBITS]


@F.pandas_udf(T.StringType())
def _texts(html: pd.Series) -> pd.Series:
    return html.map(page_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exhibits(page: pd.Series, listing: pd.Series) -> pd.Series:
    return pd.Series([exhibit_names(p, j) for p, j in zip(page, listing, strict=True)], dtype=object)


def text(html: Column) -> Column:
    return _texts(F.coalesce(html, F.lit("")))


def exhibits(index_html: Column, index_json: Column) -> Column:
    return _exhibits(F.coalesce(index_html, F.lit("")), F.coalesce(index_json, F.lit("")))


def new_filings(watchlist: DataFrame, registrants: DataFrame, submissions: DataFrame, known: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(ticker, sector, cik, company, accession, filed, document, items, base) of the newest current reports of active companies that are not known yet.

    watchlist (ticker, sector, active), registrants (cik, ticker, title),
    submissions (cik, payload), known (accession). Tickers without registrant
    and companies without submissions give nothing.
    """
    recent = F.from_json("payload", SUBMISSIONS)["filings"]["recent"]
    zipped = F.arrays_zip(*[recent[c].alias(c) for c in ("form", "accessionNumber", "filingDate", "primaryDocument", "items")])
    picked = F.slice(F.filter(zipped, lambda f: f["form"] == FORM), 1, newest)
    filed = submissions.select("cik", F.explode(picked).alias("f"))
    watched = watchlist.filter("active").select("ticker", "sector").join(registrants.select("cik", "ticker", F.col("title").alias("company")), "ticker")
    rows = watched.join(filed, "cik").select(
        "ticker", "sector", "cik", "company", F.col("f.accessionNumber").alias("accession"), F.col("f.filingDate").alias("filed"), F.col("f.primaryDocument").alias("document"), F.col("f.items").alias("items")
    )
    base = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")))
    return rows.join(known.select("accession").distinct(), "accession", "left_anti").withColumn("base", base)


def documents(filings: DataFrame, pages: DataFrame) -> DataFrame:
    """(ticker, accession, title, published, sector, items, origin, text): one document for each of ``new_filings`` whose pages (url, body) are all there.

    Pages join by address, so they may be any number; the parts of a filing
    are few and are put together in order.
    """
    at = lambda name: F.concat("base", F.lit("/"), name)
    page = lambda url, body: pages.select(F.col("url").alias(url), F.col("body").alias(body))
    index = filings.withColumns({"_i": at(F.concat("accession", F.lit("-index.htm"))), "_j": at(F.lit("index.json"))}).join(page("_i", "_index"), "_i", "left").join(page("_j", "_list"), "_j", "left")
    named = index.withColumn("_names", exhibits(F.col("_index"), F.col("_list"))).drop("_i", "_j", "_index", "_list")
    parts = named.withColumn("_parts", F.concat(F.array("document"), "_names")).select(*filings.columns, F.posexplode("_parts").alias("_at", "_name"))
    read = parts.withColumn("_url", at(F.col("_name"))).join(page("_url", "_body"), "_url", "left").withColumn("_text", F.when(F.col("_body").isNotNull(), text(F.col("_body"))))
    before, after = RULE.split("{}")
    piece = F.when(F.col("_at") == 0, F.col("_text")).otherwise(F.concat(F.lit(before), "_name", F.lit(after), "_text"))
    whole = read.withColumn("_piece", piece).groupBy(*filings.columns).agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"), F.bool_and(F.col("_piece").isNotNull()).alias("_full"))
    title = F.concat("company", F.lit(f" {FORM} filed "), "filed")
    body = F.left(F.array_join(F.col("_pieces._piece"), "\n\n"), F.lit(LONGEST))
    head = F.concat(F.lit("# title: "), title, F.lit("\n# source_type: filing\n# published: "), "filed", F.lit("\n# ticker: "), "ticker", F.lit("\n---\n"))
    return whole.filter("_full").select("ticker", "accession", title.alias("title"), F.col("filed").alias("published"), "sector", "items", F.col("base").alias("origin"), F.concat(head, body, F.lit("\n")).alias("text"))
