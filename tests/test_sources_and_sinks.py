"""Sources and sinks: files of each kind are read, and what is written reads back."""

import json

from pyspark.sql import functions as F

from lakeveil.operators import audit, elements, pages, tree
from lakeveil.plans import score
from lakeveil.sources import readers


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\ntwo</p>")
    assert [(r["html"], r["url"].endswith("a.html")) for r in readers.html_files(spark, str(tmp_path / "*.html")).collect()] == [("<p>one\ntwo</p>", True)]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "a.json").write_text(json.dumps({"name": "a", "elements": [{"id": "x", "kind": "PAN", "redact": True}, {"id": "y", "redact": False, "why": "decoy"}]}, indent=1))
    assert [tuple(r) for r in readers.truth_elements(spark, str(tmp_path / "truth")).orderBy("id").collect()] == [("a", "x", "PAN", True, None), ("a", "y", None, False, "decoy")]
    (tmp_path / "list.txt").write_text("# pages\n\nhn  https://hn.test/\n")
    assert [tuple(r) for r in readers.corpus_list(spark, str(tmp_path / "list.txt")).collect()] == [("hn", "https://hn.test/")]
    (tmp_path / "words.csv").write_text("Anna,BOB\n7up\nanna\n")
    assert sorted(r["word"] for r in readers.word_list(spark, str(tmp_path / "words.csv")).collect()) == ["anna", "bob"]
    (tmp_path / "base.json").write_text(json.dumps({"accepted": [{"id": "p/1", "why": "lost context"}, {"why": "no id"}]}, indent=1))
    accepted = readers.accepted_failures(spark, str(tmp_path / "base.json"))
    assert [tuple(r) for r in accepted.collect()] == [("p/1", "lost context")]
    failing = spark.createDataFrame([("p/2",)], "id string")
    assert sorted(tuple(r) for r in score.gate(failing, accepted).collect()) == [("p/1", "stale"), ("p/2", "new")]


def test_ledger_report_and_corpus(spark, tmp_path):
    found = spark.createDataFrame([(1, 0, 0, "PAN", "ABCPE1234F"), (1, 1, 4, "PAN", "ABCPE1234F"), (None, 0, 0, "EMAIL", "a@b.co")], "session_id long, unit_seq int, start int, kind string, value string")
    entries, ledger = audit.entries(found), str(tmp_path / "ledger")
    for day in ("2024-01-01", "2024-01-02"):
        readers.append_ledger(entries, ledger, F.lit("https://site.test"), F.lit(day))
    back = spark.read.parquet(ledger)
    assert back.count() == 4 and {r["at"].day for r in audit.retain(back, "at", 2).collect()} == {2}
    units = spark.createDataFrame([(1, 0, "value", "<PII_PAN_1>"), (1, 1, "label", "Name")], "session_id long, unit_seq int, field string, text string")
    for _ in range(2):
        readers.write_report(audit.field_view(units), audit.totals(entries), str(tmp_path / "report"))
    assert [r["verdict"] for r in spark.read.json(str(tmp_path / "report/fields")).collect()] == ["withheld"]
    assert spark.read.json(str(tmp_path / "report/totals")).where("kind is null").first()["withheld"] == 3
    site = spark.createDataFrame([(1, "u1", "<p>" * 5), (2, "u2", "<p>"), (3, "u3", None), (4, None, "<b>" * 4)], "page_id long, url string, html string")
    corpus = str(tmp_path / "corpus")
    readers.append_corpus(site, pages.capturable(site.where("page_id = 1"), least=3), corpus, F.lit("2024-01-01"))
    fresh = pages.capturable(site, spark.read.parquet(corpus), least=3)
    assert [tuple(r) for r in fresh.collect()] == [(4, 4)]
    readers.append_corpus(site, fresh, corpus, F.lit("2024-01-02"))
    assert sorted((r["page_id"], r["n_nodes"], r["captured_at"].day) for r in spark.read.parquet(corpus).collect()) == [(1, 5, 1), (4, 4, 2)]


def test_names_by_reference(spark):
    html = '<div id="a">First</div><div id="b">Second</div><div id="a">Later</div><input aria-labelledby="b  a gone" title="T"><input aria-labelledby="gone" title="T"><input aria-label="Own" aria-labelledby="a">'
    rows = elements.described(tree.elements(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")))
    assert [r["label"] for r in rows.where("tag = 'input'").orderBy("node_seq").collect()] == ["Second First", "T", "Own"]
