"""Near-dedup: pairs that the sketch bits pass over at first are compared all the same."""

from lakeveil.llm import nearsets
from test_nearsets import kept, near_copies


def test_no_pair_is_lost_by_the_bits(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "MOST_BITS", -1)  # all pairs are passed over at first
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in nearsets.keep_firsts(docs).collect()) == kept(rows)
