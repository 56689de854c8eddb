"""Null keys, repeated rows and token-like text must neither leak nor corrupt."""

import re

import pytest
from pyspark.sql import functions as F

from lakeveil.operators import audit, patterns, textstats, vault
from lakeveil.plans import queries as core

SCHEMA = "session_id long, unit_seq int, text string"


def texts(frame):
    return sorted((r["session_id"] is None, r["session_id"] or 0, r["unit_seq"] or 0, r["text"]) for r in frame.collect())


def test_null_session_and_unit_are_redacted_and_audited(spark):
    rows = [(None, 0, "null session ABCPE1234F x"), (1, None, "null unit ABCPE1234F"), (None, 1, "again ABCPE1234F")]
    units = spark.createDataFrame(rows, SCHEMA)
    clean, minted, _ = core.sanitize(units)
    assert [t[3] for t in texts(clean)] == ["null unit <PII_PAN_1>", "null session <PII_PAN_1> x", "again <PII_PAN_1>"]
    assert [t[3] for t in texts(vault.rehydrate(clean, minted))] == ["null unit ABCPE1234F", "null session ABCPE1234F x", "again ABCPE1234F"]
    assert audit.leaks(minted, units).count() == 3 and audit.leaks(minted, clean).count() == 0


def test_repeated_rows_stay_apart(spark):
    units = spark.createDataFrame([(1, 0, "dup ABCPE1234F x")] * 2, SCHEMA)
    clean, minted, found = core.sanitize(units)
    assert [r["text"] for r in clean.collect()] == ["dup <PII_PAN_1> x"] * 2
    assert [r["text"] for r in vault.rehydrate(clean, minted).collect()] == ["dup ABCPE1234F x"] * 2


@pytest.mark.parametrize("text", ["say <PII_PAN_1> and ABCPE1234F", r"<PII\_PAN_1> ABCPE1234F <PII\\_PAN_1>", "<PII_PAN_1>"])
def test_token_like_text_is_never_a_value(spark, text):
    units = spark.createDataFrame([(1, 0, text), (1, 1, "ABCPE1234F")], SCHEMA)
    clean, minted, _ = core.sanitize(units)
    shown = {r["unit_seq"]: r["text"] for r in clean.collect()}
    assert shown[0].count("<PII_PAN_1>") == text.count("ABCPE1234F")
    assert {r["unit_seq"]: r["text"] for r in vault.rehydrate(clean, minted).collect()} == {0: text, 1: "ABCPE1234F"}


def brute(text):
    """All rules over the whole folded text, without regions."""
    look = str.maketrans(patterns.CYRILLIC[0] + patterns.GREEK[0] + patterns.FULLWIDTH[0], patterns.CYRILLIC[1] + patterns.GREEK[1] + patterns.FULLWIDTH[1])
    text = text.translate(str.maketrans(patterns.WIDE, "\n" * len(patterns.WIDE)))
    return {(r.kind, m.group()) for r in patterns.RULES for m in re.finditer(r.pattern, text.translate(look))}


TEXTS = [
    "call +91 98765 43210 or 98765-43210, id 2345 6789 0124.", "card 4111 - 1111 - 1111 - 1111 now", "4111 1111 1111 1111 2345 6789 0124", "a 1 -2 -x 3 4 5 6 7 8 9 0 1 2 3 4",
    "x@y.zz,a.b@c.de;u@okaxis", "no-break 9876543210 9876543210", "नामABCPE1234F HDFC0001234 27AAPFU0939F1ZV", "12345678901234567890123", "5.666666666666667 and 0.9876543210", "", None,
]


def test_regions_hold_every_match(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "session_id long, text string")
    got = {r["session_id"]: r["regions"] for r in rows.select("session_id", patterns.regions(patterns.scannable(F.col("text"))).alias("regions")).collect()}
    for k, t in enumerate(TEXTS):
        whole, parts = brute(t or ""), set().union(*(brute(p) for p in got[k] or []), set())
        assert whole == parts, t


def test_offsets_point_at_the_value(spark):
    text = "one 9876543210\n" + "plain words\n" * 3 + "mail a.b@c.de then PAN ABCPE1234F"
    found = patterns.with_detections(spark.createDataFrame([(text,)], "text string")).first()["detections"]
    assert [text[d["start"] : d["end"]] for d in found] == ["9876543210", "a.b@c.de", "ABCPE1234F"]


def test_statistics_of_repeated_and_null_ids(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank today."
    docs = spark.createDataFrame([(None, line), (1, line), (1, line), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    rows = textstats.statistics(docs).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"] or 0)] == [None, 1, 1]
    r = rows[0]
    assert (r["words"], r["distinct_words"], r["hapax"], r["sentences"], r["top_opener"], r["opener_count"]) == (14, 12, 11, 1, "the quick", 1)


def test_audits(spark):
    clean = spark.createDataFrame([(1, 0, "left ABCPE1234F and <PII_PAN_1>"), (1, 1, "nothing"), (None, 0, "a@b.co")], SCHEMA)
    assert sorted((r["unit_seq"], r["kind"]) for r in audit.residue(clean).collect()) == [(0, "EMAIL"), (0, "PAN")]
    known = spark.createDataFrame([(None, 0, "EMAIL")], "session_id long, unit_seq int, kind string")
    assert [(r["session_id"], r["kind"]) for r in audit.residue(clean, known).collect()] == [(1, "PAN")]
    minted = spark.createDataFrame([(1, "<PII_PAN_1>", "ABCPE1234F"), (1, "<PII_NAME_1>", 'say "x"'), (2, "<PII_PAN_1>", "QQQPE1234F")], "session_id long, token string, value string")
    wire = spark.createDataFrame([(1, "abcpe-1234f"), (1, 'then say \\"x\\" quoted'), (2, "clean"), (3, "no vault")], "session_id long, text string")
    got = {r["session_id"]: (r["checked"], r["leaked"], r["verdict"]) for r in audit.transcript(minted, wire).collect()}
    assert got == {1: (2, 2, "leaked"), 2: (1, 0, "clean"), 3: (0, 0, "unchecked")}
