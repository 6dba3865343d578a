import pytest
from pyspark.sql import functions as F

from claimweave.sources import articles

LONG = "Paragraph {} of the story, which goes on for more than the forty characters that prose needs."
PROSE = "".join(f"<p>{LONG.format(i)}</p>" for i in range(4))
BODY = "\n\n".join(LONG.format(i) for i in range(4))

GOLDEN = [
    # The page's own data, nested, before anything else; escaped HTML within it.
    ('<title>Wrapper</title><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Thing","NewsArticle"],"headline":"Up","datePublished":"2026-08-01T09","articleBody":"One.\\n\\n\\n  Two &amp; three."}]}</script>' + PROSE, "", ("Up", "2026-08-01T09", "One.\n\n Two & three.")),
    ('<script type="application/ld+json">[{"mainEntityOfPage":{"@type":"TechArticle","articleBody":["<p>a</p>","b  c"]}}]</script><title> T <b>x</b></title>', "", ("Tx", "", "a\n\nb c")),
    # Broken data, and an article without a body, count as none.
    ('<script type="application/ld+json">{"@type":</script><script type="application/ld+json">{"@type":"Article","articleBody":" "}</script><title>T</title><article>' + PROSE + "</article>", "", ("T", "", BODY)),
    # A site's element: paragraphs, or blocks marked as such; sidebars stay out.
    ("<title>S</title><div class=sidebar><p>" + LONG + "</p></div><section data-type='article-body'>" + PROSE + "</section>", "https://www.wsj.com/a", ("S", "", BODY)),
    ("<title>S</title><div class='x ArticleBody-y'>" + PROSE.replace("<p>", '<div data-type="paragraph">').replace("</p>", "</div>") + "</div>", "", ("S", "", BODY)),
    ("<title>S</title><div class='markup big body'>" + PROSE + "</div><p>" + LONG, "https://a.substack.com/p", ("S", "", BODY)),
    # A marked element that is too short is passed over; then the first article element.
    ("<title>S</title><div id=article-body><p>short</p></div><article>" + PROSE + "</article>", "https://ft.com/x", ("S", "", BODY)),
    # The element with most text in paragraphs of its own; menus, captions and forms are not prose.
    ("<meta property=og:title content='O &amp; G'><meta name=date content=2020-01-02><title>no</title><nav>" + PROSE * 3 + "</nav><div><p>" + LONG.format(9) + "</div><main>" + PROSE + "<p>caption</p><form><p>" + LONG + "</form></main>", "", ("O & G", "2020-01-02", BODY)),
    # Unclosed paragraphs, lists and void elements.
    ("<div><p>" + LONG.format(0) + "<br><b>bold<p>" + LONG.format(1) + "<ul><li><p>" + LONG.format(2) + "<li>x</ul></div>", "", ("untitled", "", "\n\n".join([LONG.format(0) + " bold", LONG.format(1), LONG.format(2)]))),
    ("", "", ("untitled", "", "")),
    (None, None, ("untitled", "", "")),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden_pages(case):
    html, url, want = GOLDEN[case]
    assert articles.read_article(html, url) == want


def test_plain_text():
    assert articles.plain_text("<p>a <b>b</b></p><script>x</script>lost<p> </p><p>c&nbsp;</p>") == "a b\n\nc"
    assert articles.plain_text("one<br>two\n <div> three</div><style>s</style>") == "one\n\ntwo\n\nthree"
    assert articles.plain_text(None) == articles.plain_text("<p></p>") == ""


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + PROSE
    assert articles.read_article(deep)[2] == BODY
    assert articles.read_article("<p>" + "word " * 300_000)[2] == ("word " * 300_000).strip()
    assert articles.read_article("</div>" * 10_000 + "<li>" * 5_000 + "<" + PROSE)[0] == "untitled"


def test_uploaded_files(spark, tmp_path):
    from claimweave.session import importable_by_workers

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "page.HTM").write_text(f'<title>A page</title><meta name="date" content="2024-05-06T07:08"><article>{PROSE}</article>')
    (tmp_path / "in" / "notes.v2.txt").write_bytes(b"plain \xff words")
    files = importable_by_workers(spark).read.format("binaryFile").load(str(tmp_path / "in"))
    got = {r.n: r.doc for r in files.select(F.element_at(F.split("path", "/"), -1).alias("n"), articles.upload(F.col("path"), F.col("content")).alias("doc")).collect()}
    assert got["page.HTM"] == f"# title: A page\n# source_type: article\n# published: 2024-05-06\n---\n{BODY}\n"
    assert got["notes.v2.txt"] == "# title: notes.v2\n# source_type: document\n---\nplain � words\n"
