"""The network of operator 7 learns from the findings of all rows, whatever the partitions."""

import numpy as np

from lakeveil.llm import logistic, secrets


def test_every_row_trains_or_calibrates(spark, monkeypatch):
    n, held, trained = 6400, [], []
    docs = spark.range(n).selectExpr("nullif(id, 7) as doc_id", "concat('token = ', md5(cast(id as string)), ' here') as text")
    real = secrets._round
    monkeypatch.setattr(secrets, "platt", lambda z, y: held.append(y) or logistic.platt(z, y))
    monkeypatch.setattr(secrets, "_round", lambda dealt, *rest: trained.append(dealt.where("not back").count()) or real(dealt, *rest))
    secrets.fit_secrets(docs, rounds=1)
    # A row has six examples: its secret as it is, without its key word and with another value, and a word as it is and with two made-up values.
    assert int(held[0].sum()) + trained[0] == 6 * n and 0.2 * 6 * n < held[0].sum() < 0.3 * 6 * n


def test_partitions_and_their_order_change_nothing(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('some words and password: ', md5(cast(id as string)), ' of /usr/share/file-', id) as text")
    a, b = (secrets.fit_secrets(d, block_rows=100, rounds=2) for d in (docs.coalesce(1), docs.repartition(5)))
    assert all(np.array_equal(x, y) for x, y in zip(a.parts(), b.parts())) and (a.a, a.b, a.threshold, a.precision) == (b.a, b.b, b.threshold, b.precision)
    assert a.precision > 0.5 and not np.array_equal(a.embed, secrets.SecretNet.fresh().embed)


def test_calibration_from_counts_is_that_from_values():
    z, up = np.array([-2.0, -1.0, -1.0, 0.5, 0.5, 0.5, 3.0]), np.array([0, 0, 1, 0, 1, 1, 1])
    at = np.unique(z)
    counts = np.array([[np.sum((z == k) & (up == y)) for y in (0, 1)] for k in at])
    assert np.allclose(logistic.platt(z, up), logistic.platt(at, counts))
