"""The pipeline's near-dedup stage against brute force over all pairs."""

import random

import corpus_pipeline
from lakeveil.llm import nearsets


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(d for i, (d, _) in enumerate(rows) if find(i) == i)


def near_copies():
    """Groups of texts with one to five words changed, so that similarities lie on both sides of 0.8."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [None, "", "One two", "one TWO", "x"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 200))]
        for _ in range(12):
            own = list(base)
            for _ in range(r.randint(1, 5)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own).title())
    return list(enumerate(texts))


def test_near_copies_of_a_similarity_of_four_fifths_go(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = kept(rows)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == want
    assert 12 < len(want) < 140


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "A B C"), (None, "g")], "doc_id long, text string")
    assert sorted(x["text"] for x in nearsets.keep_firsts(docs).collect()) == ["a b c", "d e f", "g"]
    assert nearsets.keep_firsts(docs.where("false")).count() == 0


def test_blocks_of_a_band_give_the_same(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(nearsets, "BLOCK_BYTES", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in nearsets.keep_firsts(docs).collect()) == kept(rows)
