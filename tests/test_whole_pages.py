"""Queries of pages read the pages whole: what stands in a page itself is withheld and counted, in the query and in its SQL."""

import __spark_entry__
from oracle import compare


def test_withheld_counts_hold_the_values_of_the_pages_themselves(spark, tmp_path):
    head = "<html><head><title>About</title></head><body><article><h1>About</h1>"
    rows = [
        (1, "https://a.example.com/x", f"{head}<p>Paid with 4111111111111111 by jo.doe@mail1.example.com</p><p>Next, info@mail1.example.com.</p></article></body></html>"),
        (2, "https://b.test/", f"{head}<p>Order total</p><p>4111111111111111</p>"),
        (3, "https://b.test/", f"{head.replace('About', '4111111111111111')}<p>Cut <b>off 12345"),
        (4, "https://c.test/", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "made"))
    (next((tmp_path / "made").glob("*.parquet"))).rename(tmp_path / "pages.parquet")
    query = __spark_entry__.queries()["r10_page_withheld"]
    got = {r["kind"]: (r["withheld"], r["org_contacts"]) for r in query(spark, str(tmp_path)).collect()}
    # Page 1: a paragraph and its like as the next one's context; page 2: kept in a field of amounts; page 3: title, heading and the context of the paragraph.
    assert got == {"CARD": (5, 0), "EMAIL": (6, 5)}
    assert compare(spark, str(tmp_path), query, __spark_entry__.oracle_sql()["r10_page_withheld"]) == ""
