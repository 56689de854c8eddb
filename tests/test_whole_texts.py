import collections
import re

from lakeveil.operators import patterns
from lakeveil.plans import queries as core

TEXTS = ["pay ananya@okaxis or a.b@c.de, x@y", "4111 1111 1111 1111 and 4111111111111112; 2345 6789 0124", "ABCPE1234F HDFC0001234 9876543210 27AAPFU0939F1ZV", "nothing", None]


def test_candidates_of_all_rules_are_counted(spark):
    want, docs = collections.Counter(), collections.Counter()
    for t in TEXTS:
        for rule in patterns.RULES:
            n = len(re.findall(rule.pattern, t or ""))
            want[rule.kind] += n
            docs[rule.kind] += n > 0
    units = spark.createDataFrame(list(enumerate(TEXTS)), "session_id long, text string")
    got = {r["kind"]: (r["candidates"], r["documents"]) for r in core.count_candidates(units).collect()}
    assert got == {k: (n, docs[k]) for k, n in want.items() if n}
    assert set(got) == {r.kind for r in patterns.RULES}
    assert "d2_all_candidates" in core.queries()


def test_the_whole_text_is_scored(spark):
    texts = ["mail a.b@c.de and ABCPE1234F", "card 4111 1111 1111 1111", None, "x\u200b ABCPE1234F y"]
    units = core.inject(spark.createDataFrame(list(enumerate(texts)), "session_id long, text string"))
    hits = {r["kind"]: (r["rows"], r["hits"], r["false_alarms"]) for r in core.score_injected(units).collect()}
    assert hits == {"PAN": (1, 1, 0), "AADHAAR": (1, 1, 0), "GSTIN": (1, 1, 0), "CARD": (1, 1, 0)}
    others = {r["kind"]: (r["detections"], r["documents"]) for r in core.other_detections(units).collect()}
    assert others == {"EMAIL": (1, 1), "PAN": (2, 2), "CARD": (1, 1)}
    swallowed = spark.createDataFrame([(6, "UPI: x\nananya@okaxis.")], "session_id long, text string")  # the value doesn't stand at the end
    assert core.score_injected(swallowed).first()["hits"] == 0
