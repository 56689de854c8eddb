"""Copies of a row and rows that share a key are dealt like any others."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from lakeveil.llm import mixing, sharding


def test_copies_fall_into_shards_and_slots_of_their_own(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    mixed = mixing.apply_rates(docs, docs.select("doc_id", F.lit(4.0).alias("rate")), copy_col=corpus_pipeline.COPY)
    out = corpus_pipeline.shard(spark, mixed, "")
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    shards, slots = collections.defaultdict(list), collections.defaultdict(list)
    for r in out.collect():
        shards[r["doc_id"]].append(r["shard"])
        slots[r["doc_id"], r["shard"]].append(r["slot"])
    assert all(len(v) == 4 for v in shards.values())
    together = sum(len(v) - len(set(v)) for v in shards.values())
    assert together < 60  # 30 if all is by chance; 600 if a document's copies stay together
    beside = sum(b - a == 1 for v in slots.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    assert beside < together


def test_a_hot_key_is_spread(spark):
    rows = [(None if k % 3 == 0 else k, f"text {k}") for k in range(900)]
    out = sharding.shuffle_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).where("doc_id is null")
    counts = sorted(r["count"] for r in out.groupBy("shard").count().collect())
    assert len(counts) == 10 and counts[0] >= 12 and counts[-1] <= 50
