"""Streams with state beside their batches."""

import time

from pyspark.sql import functions as F

from lakeveil.operators import runs, vault
from lakeveil.streaming import streams

SCHEMA = "session_id string, unit_seq int, start int, kind string, value string"


def rows_of(part):
    return [(f"s{k % 3}" if k % 5 else None, part * 100 + k, 7 * (k % 4), ("PAN", "CARD")[k % 2], f"v{(part * 37 + k) % 50}") for k in range(60)]


def replay(spark, tmp_path, frame, **more):
    out = []
    query = frame.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda rows, _: out.extend(tuple(r) for r in rows.collect())).trigger(**(more or {"availableNow": True})).start()
    return query, out


def test_vault_of_an_ordered_replay_is_the_batch_vault(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    for part in range(3):
        spark.createDataFrame(rows_of(part), SCHEMA).repartition(2).write.parquet(str(tmp_path / "in" / f"{part}"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    query, out = replay(spark, tmp_path, streams.vault_stream(stream), processingTime="1 second")
    every = spark.createDataFrame([x for part in range(3) for x in rows_of(part)], SCHEMA)
    want = {tuple(r) for r in vault.mint(every).select("session_id", "kind", "n", "token", "value").collect()}
    end = time.time() + 60
    while len(out) < len(want) and time.time() < end:
        time.sleep(0.5)
    query.stop()  # a stream with timers runs on, with or without rows
    assert len(out) == len(set(out)) and set(out) == want


def test_a_quiet_session_is_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    folder = tmp_path / "in"
    row = lambda: spark.createDataFrame([("s", 1, 0, "PAN", "v")], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    row()
    query, out = replay(spark, tmp_path, streams.vault_stream(spark.readStream.schema(SCHEMA).parquet(str(folder)), quiet=3), processingTime="1 second")
    try:
        for seen in (1, 2):  # the second time after the timer: minted anew
            end = time.time() + 60
            while len(out) < seen and time.time() < end:
                time.sleep(0.5)
            if seen == 1:
                time.sleep(10)
                row()
        assert [o[3] for o in out] == ["<PII_PAN_1>"] * 2
    finally:
        query.stop()


def test_withheld_by_window_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("o").alias("origin"), F.col("event_type").alias("kind"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    query, out = replay(spark, tmp_path, streams.withheld_by_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))))
    query.awaitTermination(180)
    want = {tuple(r) for r in streams.withheld_by_window(events).collect()}
    assert out and set(out) <= want and len(want) - len(out) < 20  # windows behind the watermark are still open


def test_threads_folded_as_a_stream(spark, tmp_path):
    """Three triggers, the last of them with turns that come late, against the fold of all turns."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    schema = "thread_id string, at long, summary string, withheld long, reason string, question string"
    reasons = ["open", "ask-user", "done", "needs-user-input", "answered"]
    every = [(f"t{k % 7}" if k % 11 else None, k, f"s{k}", k % 3 or None, reasons[k % 5], f"q{k}" if k % 5 in (1, 3) else None) for k in range(90)]
    for nth, part in enumerate((every[:30], every[60:], every[30:60])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{nth}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = []
    query = streams.fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda rows, n: out.extend((n, r) for r in rows.collect())).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while sum(len(r["new_turns"]) for _, r in list(out)) < len(every) and time.time() < end:
        time.sleep(0.5)
    query.stop()  # a stream whose state can expire runs on, with or without rows
    heads, told = {}, {}
    for _, r in sorted(out, key=lambda x: x[0]):
        heads[r["thread_id"]] = (r["status"], r["pending"], r["created_at"], r["updated_at"], r["withheld"])
        told.setdefault(r["thread_id"], []).extend(tuple(t) for t in r["new_turns"])
    want = runs.fold_threads(spark.createDataFrame(every, schema)).collect()
    assert len({n for n, _ in out}) == 3 and heads == {r["thread_id"]: (r["status"], r["pending"], r["created_at"], r["updated_at"], r["withheld"]) for r in want}
    assert {k: sorted(v) for k, v in told.items()} == {r["thread_id"]: [tuple(t) for t in r["turns"]] for r in want}
