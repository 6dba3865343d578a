"""Pages made of words whose length is around that of a paragraph."""

import duckdb

from claimweave.plans import registry
from claimweave.sources import articles


def test_words_about_as_long_as_a_paragraph_as_in_sql(spark, tmp_path):
    rows = [(i * 4 + k, "a" * n, "en", "src", n) for i, n in enumerate(range(34, 46)) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = f"SELECT doc_id, title, published, body FROM ({registry.oracle_sql()['src_article_read'].split('--more')[-1]})"
    others = "region nation customer supplier part orders lineitem events".split()
    for t in others:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    out = registry.queries()["src_article_read"](spark, str(tmp_path)).select("doc_id", "title", "published", "body").collect()
    assert sorted(map(tuple, out)) == sorted(con.execute(sql).fetchall())


def test_a_paragraph_exceeds_forty_characters():
    read = lambda n: articles.read_article(f"<article><p>{'a' * n}<p><i>{'a' * n}</i> end</article>")[2]
    assert [read(n) for n in (36, 37, 40, 41)] == ["", "a" * 37 + " end", "a" * 40 + " end", "a" * 41 + "\n\n" + "a" * 41 + " end"]
