"""Character references in SQL are read as the tree reads them."""

import html
import tempfile

import duckdb
from oracle import compare

from lakeveil.functions import references
from lakeveil.plans import queries as core


def test_sql_reads_references_as_the_tree_does():
    texts = [f"a&{n}b" for n in references.NAMED] + [f"&#{k};x" for k in (*range(300), 0xD800, 0xFFFF, 0x10FFFF, 0x110000, 10**50)] + [f"&#x{k:x}" for k in (0, 11, 128, 65, 0xDFFF, 16**40)]
    texts += ["&", "&#", "&#;", "&#x;", "&amp;amp;", "&am", "x &quo", "&amp", "&notit;", "&noti", "&ampx;&lt", "a & b;", "&" + "a" * 40 + ";", "plain"]
    con = duckdb.connect()
    con.execute("create table d (k int, raw varchar)")
    con.execute("insert into d select * from (select unnest(?), unnest(?))", [list(range(len(texts))), texts])
    assert dict(con.sql(f"with {references.sql_decoded('y', 'd', 'k', 'raw')} select * from y").fetchall()) == {k: html.unescape(t) for k, t in enumerate(texts)}


def test_titles_cut_within_a_reference_and_rare_blanks_have_equal_sql(spark):
    titles = ["the&amp;&amp", "a&quo", "fish&lt", "caf&eacute;  bar", "x&#8212;y", "", None]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(k, f"https://a.test/{k}", None if t is None else f"<html><head><title>{t}</title></head><body><h1>{t}</h1></body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    sql = core.oracle_sql()["p3_own_text"].replace("from pages)", f"from read_parquet('{folder}/pages.parquet/*.parquet'))")
    assert compare(spark, folder, core.queries()["p3_own_text"], sql) == ""
