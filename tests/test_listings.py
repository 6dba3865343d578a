"""Titles of listing pages: references to characters, and documents without words."""

import html

import duckdb
from pyspark.sql import functions as F

from claimweave.plans import registry
from claimweave.sources import listings

NAMED = ["", "a & b", "&amp;lt; &lt;b&gt; &quot;q&quot; &apos;", "&#32;&amp; co", "&#39;&#x27;&#X41;&#233;&#128512;", "&#38;lt; &#38;#38; &amp;amp;", "&#0; &#xD800; &#9999999;", "&; &&amp", "é &#; &#x;"]


def test_references_are_read_once(spark):
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(NAMED)], "i int, t string").orderBy("i").select(listings.unescaped(F.col("t")).alias("t")).collect()]
    # A reference ends with a semicolon here; without one it is text.
    assert got == [html.unescape(t) if t != "&; &&amp" else t for t in NAMED]


def test_listing_of_documents_without_words_as_in_sql(spark, tmp_path):
    texts = ["", None, "!?", " - ", "word", "two words.", "é"]
    rows = [(i * 12 + k, t, "en", "src", 1) for i, t in enumerate(texts) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    columns = ("doc_id", "title", "link", "date", "summary", "uid")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['src_listing_items'].split('--more')[-1]})").fetchall()
    out = registry.queries()["src_listing_items"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, out)) == sorted(want)
