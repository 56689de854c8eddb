import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lakeveil.functions import checksums
from lakeveil.operators import audit, pages, patterns, vault
from lakeveil.plans import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert oracle.compare(spark, oracle.scale(), core.queries()[name], SQL[name]) == ""


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


# Numbers with known check digits.
CASES = [
    ("AADHAAR", "2345 6789 0124", True), ("AADHAAR", "234567890125", False), ("AADHAAR", "123456789012", False), ("CARD", "4111 1111 1111 1111", True), ("CARD", "4111111111111112", False),
    ("GSTIN", "27AAPFU0939F1ZV", True), ("GSTIN", "27AAPFU0939F1ZW", False), ("PAN", "ABCPE1234F", True), ("PAN", "ABCXE1234F", False), ("IFSC", "HDFC0001234", True), ("IFSC", "HDFC1001234", False),
    ("UPI", "ananya@okaxis", True), ("PHONE", "+91 98765 43210", True), ("PHONE", "12345 67890", False), ("EMAIL", "a@b.co", True), ("EMAIL", "a@b", False), ("NAME", "Asha", False),
]


def test_checksums(spark):
    rows = spark.createDataFrame(CASES, "kind string, raw string, want boolean")
    wrong = rows.withColumn("got", checksums.verify(F.col("kind"), F.col("raw"))).where("got <> want").collect()
    assert wrong == []


def detections(spark, text):
    rows = patterns.with_detections(spark.createDataFrame([(text,)], "text string")).first()["detections"]
    return [(d["kind"], text[d["start"] : d["end"]], d["verified"]) for d in rows]


def test_detections_and_overlaps(spark):
    assert detections(spark, "PAN ABCPE1234F, card 4111 1111 1111 1111.") == [("PAN", "ABCPE1234F", True), ("CARD", "4111 1111 1111 1111", True)]
    assert detections(spark, "mail ananya.rao@example.co.in") == [("EMAIL", "ananya.rao@example.co.in", True)]
    assert detections(spark, "ratio 5.666666666666667 and nothing") == []
    assert detections(spark, None or "") == []
    assert detections(spark, "नामABCPE1234F") == [("PAN", "ABCPE1234F", True)]


def test_disguised_values_keep_their_own_offsets(spark):
    text = "x AB​CPЕ1234F y"
    assert detections(spark, text) == [("PAN", "AB​CPЕ1234F", True)]


def test_tokens_are_stable_by_session_and_minted_from_the_right(spark):
    units = spark.createDataFrame([(1, 0, "ABCPE1234F and AAAPA1111A"), (1, 1, "again ABCPE1234F"), (2, 0, "ABCPE1234F"), (3, 0, None)], "session_id long, unit_seq int, text string")
    clean, minted, _ = core.sanitize(units)
    got = {(r[0], r[1]): r[2] for r in clean.select("session_id", "unit_seq", "text").collect()}
    assert got == {(1, 0): "<PII_PAN_2> and <PII_PAN_1>", (1, 1): "again <PII_PAN_2>", (2, 0): "<PII_PAN_1>", (3, 0): None}
    back = {(r[0], r[1]): r[2] for r in vault.rehydrate(clean, minted).select("session_id", "unit_seq", "text").collect()}
    assert back == {(1, 0): "ABCPE1234F and AAAPA1111A", (1, 1): "again ABCPE1234F", (2, 0): "ABCPE1234F", (3, 0): None}
    assert "value" not in clean.columns


def test_leak_audit_has_a_control(spark):
    counts = {r["channel"]: r["leaks"] for r in core.v1_leaks(spark, oracle.scale()).collect()}
    assert counts["sanitized"] == 0 and counts["raw"] > 0


def test_masked_previews(spark):
    rows = spark.createDataFrame([("PASSWORD", "x"), ("PAN", "ABCPE1234F"), ("PAN", "AB")], "kind string, value string")
    assert [r[0] for r in rows.select(audit.masked(F.col("kind"), F.col("value"))).collect()] == ["••••••••", "AB•••••••F", "•••"]


def test_origins_and_questions(spark):
    rows = spark.createDataFrame([("https://u@a.b:443/x",), ("http://a.b:8080",), ("nope",)], "u string")
    assert [r[0] for r in rows.select(pages.origin(F.col("u"))).collect()] == ["https://a.b", "http://a.b:8080", "about:blank"]
    asks = spark.createDataFrame([("However it is",), ("Fill the form",), ("Done?",), (None,)], "g string")
    assert [r[0] for r in asks.select(pages.is_question(F.col("g"))).collect()] == [True, False, True, False]
