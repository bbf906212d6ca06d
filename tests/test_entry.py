"""Every query of the library against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from dramatis.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    frame = catalogue.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in catalogue.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == sorted(frame.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in rows) == Counter(want.fetchall())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["page_id", "base_url", "link", "score", "rank"]
    frame.collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Titles as pages write them: entities cut off, of several kinds, in two lines, beside white space, with a tag or a second title.
TITLES = [
    "<title>a &amp;&amp; b&amp</title>", "<title>token = &quot;77</title>", "<title>x &am</title>", "<title>  Acme &lt;b&gt; &amp;quot; | Home </title>", "<title>line\nbreak &#38; more</title>",
    "\n\n<title>ßieung</title>", "<title>one</title><title>two</title>", "<title></title>", "", "<title>ﬁrm &laquo;x&raquo;</title>", "<title>" + "long &quot; " * 20 + "</title>",
]


@pytest.mark.parametrize("name", ["page_title_lang", "company_name_candidate"])
def test_titles_as_written(spark, tmp_path, name):
    # A name's words are joined by single spaces, in the reference too, so a line break in it is no matter of its SQL.
    titles = [t for t in TITLES if name == "page_title_lang" or "line\n" not in t]
    pages = [(k, "https://a.example/", f'<html lang="EN-us"><head>{t}</head><body>x &amp; y</body></html>') for k, t in enumerate(titles)]
    pages += [(100, "https://a.example/", "<html><head><title>no lang</title></head></html>"), (101, "https://a.example/", ""), (102, "https://a.example/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect())) == sorted(want.fetchall())
