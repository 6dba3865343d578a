import json

from pyspark.sql import functions as F

from claimweave.session import importable_by_workers
from claimweave.sources import filings, listings


def index(*rows):
    return "<table>" + "".join(f"<tr><td>{i}<td>d<td>{link}<td>{kind}" for i, (link, kind) in enumerate(rows)) + "</table>"


def test_exhibits_by_type_else_by_name():
    a = lambda href: f"<a href='{href}'>x</a>"
    assert filings.exhibit_names(index((a("/A/main.htm"), "8-K"), (a("/ix?doc=/A/e1.htm"), "EX-99.1"), (a("/A/pic.jpg"), "ex-99.2"), (a("/A/e3.HTML"), "EX-99.3"), ("none", "EX-99.4")), None) == ["e1.htm", "e3.HTML"]
    assert len(filings.exhibit_names(index(*[(a(f"/e{i}.htm"), "EX-99") for i in range(5)]), None)) == 3
    listing = json.dumps({"directory": {"item": [{"name": n} for n in ("a.htm", "x_ex99-1.htm", "EX-99b.html", "ex99.pdf")]}})
    assert filings.exhibit_names("<tr><td>1<td>2</tr>", listing) == ["x_ex99-1.htm", "EX-99b.html"]
    assert filings.exhibit_names(None, "[]") == filings.exhibit_names("", '{"directory":7}') == []


def test_page_text():
    assert filings.page_text("<title>T</title><style>x</style><p>a\xa0 \tb</p>\n\n\n<div>c<br>d</div>") == "T\na b\n\nc\nd"


def test_new_filings_become_documents(spark):
    importable_by_workers(spark)
    recent = lambda rows: json.dumps({"filings": {"recent": {k: [r[i] for r in rows] for i, k in enumerate(("form", "accessionNumber", "filingDate", "primaryDocument", "items"))}}})
    submissions = [
        (1, recent([("10-K", "a-0", "2024-05-05", "k.htm", ""), ("8-K", "a-1", "2024-05-04", "m.htm", "2.01"), ("8-K", "a-2", "2024-05-03", "m.htm", ""), ("8-K", "a-3", "2024-05-02", "m.htm", "")])),
        (2, recent([("8-K", "b-1", "2024-01-01", "m.htm", "5.02")])), (3, "broken"), (4, recent([("8-K", "d-1", "2024-02-02", "m.htm", "")])),
    ]
    base = "https://www.sec.gov/Archives/edgar/data"
    pages = [(f"{base}/1/a1/m.htm", "<p>Main " + "x" * 100), (f"{base}/1/a1/a-1-index.htm", index(("<a href='/e.htm'>e</a>", "EX-99.1"))), (f"{base}/1/a1/e.htm", "<p>Press</p>"), (f"{base}/2/b1/m.htm", "y" * 90_000), (f"{base}/4/d1/m.htm", "ok"), (f"{base}/4/d1/index.json", '{"directory":{"item":[{"name":"ex99.htm"}]}}')]
    frame = spark.createDataFrame
    some = filings.new_filings(
        frame([("A", "s1", True), ("B", "s2", True), ("C", None, True), ("D", None, True), ("E", None, True), ("Z", None, False)], "ticker string, sector string, active boolean"),
        frame([(1, "A", "Alpha"), (2, "B", "Beta"), (3, "C", "Gamma"), (4, "D", "Delta")], "cik long, ticker string, title string"), frame(submissions, "cik long, payload string"), frame([("a-2",), ("a-2",)], "accession string"),
    )
    assert sorted(r.accession for r in some.collect()) == ["a-1", "b-1", "d-1"]
    out = {r.accession: r for r in filings.documents(some, frame(pages, "url string, body string")).collect()}
    assert set(out) == {"a-1", "b-1"}  # an exhibit of d-1 is not there
    assert out["a-1"].text == "# title: Alpha 8-K filed 2024-05-04\n# source_type: filing\n# published: 2024-05-04\n# ticker: A\n---\nMain " + "x" * 100 + "\n\n---- EXHIBIT e.htm ----\n\nPress\n"
    assert (out["a-1"].sector, out["a-1"].items, out["a-1"].origin) == ("s1", "2.01", f"{base}/1/a1")
    assert len(out["b-1"].text.split("---\n", 1)[1]) == 80_001


def test_videos_and_listings(spark):
    feed = "<feed><title>Chan &amp; Co</title><entry><yt:videoId> v1 </yt:videoId><title><![CDATA[A <b>]]></title><published>2024-01-02T03:04</published><author><name>N &amp; M</name></author></entry><entry><link href='https://x/?v=v-2'/></entry><entry><title>none</title></entry></feed>"
    page = '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {
        "latestArticles": [{"articleUrl": "https://www.wsj.com/a", "headline": " One &amp; all ", "timestamp": "2024-03-04T00:00:00Z", "summary": " s ", "id": 7}, {"articleUrl": "https://www.wsj.com/video/b", "headline": "V"}, {"articleUrl": "https://www.wsj.com/v", "headline": "V", "isVideo": True}, {"articleUrl": "https://evil.com/wsj.com", "headline": "E"}, {"headline": "no link"}],
        "latestVideos": [{"articleUrl": "https://www.wsj.com/z", "headline": "Z"}], "moreInArticlesInitial": 5, "authorFeedArticles": [{"articleUrl": "https://www.wsj.com/a", "headline": "again"}, {"articleUrl": "https://wsj.com/c", "headline": "C", "seoId": "c-1"}, {"articleUrl": "https://wsj.com/d", "headline": "D"}]}}}) + "</script>"
    rows = spark.createDataFrame([(feed, page), ("", "<p>"), (None, None)], "f string, p string").select(listings.videos(F.col("f")).alias("v"), listings.feed_title(F.col("f")).alias("t"), listings.listed(F.col("p")).alias("l")).collect()
    assert [tuple(v) for v in rows[0].v] == [("v1", "A <b>", "2024-01-02", "N & M", listings.WATCH + "v1"), ("v-2", "v-2", "", "", listings.WATCH + "v-2")]
    assert rows[0].t == "Chan & Co" and rows[1].v == rows[2].v == rows[1].l == rows[2].l == []
    assert [tuple(x) for x in rows[0].l] == [("One & all", "https://www.wsj.com/a", "2024-03-04", "s", "7"), ("C", "https://wsj.com/c", "", "", "c-1"), ("D", "https://wsj.com/d", "", "", "https://wsj.com/d")]
