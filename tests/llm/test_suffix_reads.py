"""Disk of operator 8: each text is exchanged once, for full buckets, small ones and the end, and a checkpoint leaves no shuffle files."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lakeveil.llm import checkpoints, suffixes


def removed(rows, length):
    """Bytes of each text covered by a string that starts earlier, by brute force."""
    seen, out = {}, {}
    for d, text in rows:
        gone = set()
        for k in range(len(text) - length + 1):
            if text[k : k + length] in seen:
                gone.update(range(k, k + length))
            seen.setdefault(text[k : k + length], d)
        out[d] = len(gone)
    return out


def test_a_text_is_exchanged_once(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST", 20)
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    line, few = noise(110), noise(130)
    rows = [(k, noise(80) + (line if k % 2 else few if k % 20 == 0 else "") + noise(80)) for k in range(200)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.drop_repeats(docs, bits=16).collect()}
    assert got == removed(rows, 100)
    # For the size, the sketch, segments, firsts, and the one exchange of texts.
    assert read.value == 5 * len(rows)


def test_a_checkpoint_leaves_nothing_shuffled_and_the_setting_as_it_was(spark):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before, old = spark.conf.get(checkpoints.CLEANUP, None), shuffled()
    rows = checkpoints.durable(spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffled() <= old and spark.conf.get(checkpoints.CLEANUP, None) == before
    assert sorted((x["k"], x["count"]) for x in rows.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
