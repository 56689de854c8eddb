"""A line that many documents share with different neighbours fills no bucket."""

import random

from pyspark.sql import functions as F

from lakeveil.llm import suffixes


def test_a_common_line_fills_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST", 20)
    r = random.Random(6)
    noise = lambda: "".join(r.choice("abcdefghijklmnop ") for _ in range(80))
    line = "".join(r.choice("ABCDEFGHIJKLMNOP") for _ in range(110))
    docs = spark.createDataFrame([(k, noise() + line + noise()) for k in range(300)], "doc_id long, text string")
    sizes = []
    factors = suffixes._factors

    def watched(parts, length):
        sizes.append(parts.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0)
        return factors(parts, length)

    monkeypatch.setattr(suffixes, "_factors", watched)
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.drop_repeats(docs, bits=16).collect()}
    assert got[0] == 0 and all(got[k] >= 110 for k in range(1, 300))
    assert sizes[0] <= 20
