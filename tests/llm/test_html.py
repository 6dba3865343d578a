import random

import numpy as np
import pytest

from claimweave.llm import boosting, html_text

SENTENCES = [f"{' '.join(random.Random(i).choices(['alpha', 'beta', 'of', 'gamma', 'delta', 'in', 'omega'], k=4 + i % 9)).capitalize()}." for i in range(200)]


@pytest.fixture(scope="module")
def model():
    return html_text.fit(SENTENCES, 300)


def wrap(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{article}{after}</body></html>"


NAV = "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li><li><a href='/c'>Three</a></li></ul></nav>"
FOOT = "<footer>&copy; example &middot; All rights reserved.</footer>"


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    fitted = boosting.fit(x[:2000], y[:2000])
    assert ((fitted.logit(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_generated_pages_held_out(model):
    wrong = total = 0
    for seed in range(9000, 9080):
        root = html_text.parse(html_text.generate(SENTENCES, seed))
        nodes = html_text.nodes_of(root)
        found = model.logit(html_text.features(nodes, root)) > 0
        wrong += (found != np.array([n.role for n in nodes])).sum()
        total += len(nodes)
    assert wrong / total < 0.02


def test_pages(model):
    body = "".join(f"<p>{SENTENCES[i]} {SENTENCES[i + 1]}</p>" for i in range(0, 12, 2))
    plain = " ".join(SENTENCES[:12])
    assert html_text.extract_all([wrap(f"<article><h1>Head &amp; line</h1>{body}</article>", NAV, FOOT)], model) == [f"Head & line {plain}"]
    odd = "<article><h1>A</h1><p><b>B<br><p>C&nbsp;d <i>e</i>f\n\n g</p><!-- no --></article>"
    assert html_text.extract_all([wrap(odd, NAV + "<div class='ad'>Buy this now.</div>", FOOT)], model) == ["A B C d ef g"]
    said = f"<section class='comments'><h3>Comments</h3><div class='comment'><p>Nice. {SENTENCES[5]}</p></div><div class='comment'><p>Bad.</p></div></section>"
    assert html_text.extract_all([wrap(f"<article>{body}{said}</article>", NAV, FOOT)], model) == [plain]


def test_broken_pages_do_not_crash(model):
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "<", ">", "&amp", "&#x110000;", "<![x", "<!", "<!--", "-->", "</", "<script>", "</script>", "text ", "<li>", "<td>", "<table>", "\0", "<a href='", "é", "<?pi", "<textarea>", "<br/>", "<div/>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["<div>" * 3000 + "x", "<p>" * 5000, "<b>" * 5000 + "y"]
    assert len(html_text.extract_all(pages, model)) == len(pages)
    assert html_text.extract_all([None, "", "just a  text", "<p data-role-known='z'>x y z.</p>"], model)[:3] == ["", "", "just a text"]


def test_frames(spark, model):
    rows = [(1, "http://a", wrap(f"<article><p>{SENTENCES[0]} {SENTENCES[1]}</p></article>", NAV, FOOT), "t"), (2, None, None, None), (None, "", "", ""), (2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract_pages(pages, model)
    assert out.columns == ["page_id", "url", "text"] and out.count() == 4
    assert {r.text for r in out.collect()} == {"", f"{SENTENCES[0]} {SENTENCES[1]}"}
    assert html_text.extract_pages(pages.limit(0), model).count() == 0
    assert html_text.sample_sentences(pages.limit(0))
