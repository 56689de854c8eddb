"""Every long run is scored, to its end, and the threshold keeps the recall it names."""

import numpy as np

from lakeveil.llm import secrets


def found(spark, text):
    """Spans of a network that fires where its window shows a Z or an exclamation mark."""
    net = secrets.SecretNet(*(np.zeros_like(w) for w in (lambda n: (n.embed, n.conv, n.conv_bias, n.out))(secrets.SecretNet.fresh())), threshold=0.5)
    net.embed[[ord("Z"), 256 + ord("Z"), ord("!")], 0] = 1
    net.conv[:: secrets.DEPTH, 0] = 1
    net.out[0], net.out[-1] = 10, -5
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(f["kind"], f["start"], f["end"]) for f in secrets.scan_secrets(docs, net).first()["found"]]


def test_runs_of_letters_or_digits_are_scored(spark):
    assert found(spark, "see " + "Z" * 20) == [("model", 4, 24)]
    assert found(spark, "see " + "9" * 20 + "!") == [("model", 4, 24)]


def test_the_tail_of_a_long_run_and_what_follows_are_read(spark):
    for n in (63, 64, 65, 95, 96, 97, 200, 333):
        assert found(spark, "g1" * (n // 2) + "gZ tail") == [("model", 0, n // 2 * 2 + 2)], n
    for n in (66, 96, 98, 202):
        assert found(spark, "g1" * (n // 2) + " " * 31 + "!") == [("model", 0, n)], n


def test_threshold_is_the_recall_quantile(spark, monkeypatch):
    monkeypatch.setattr(secrets, "platt", lambda z, y: (1.0, -20.0))  # all scores far below one half
    rows = [(k, f"token = {k:032x} and some more words of /usr/share/file-{k:04d}/name-{k:06d} here") for k in range(200)]
    net = secrets.fit_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert net.threshold < 0.5 and 0 < net.precision <= 1
