"""What detection costs: texts are folded where folding changes them, a query detects once, and only what is judged is shuffled."""

from pyspark.sql import functions as F

from lakeveil.operators import patterns, vault
from lakeveil.plans import field_queries, score
from lakeveil.plans.holdout import BLOCKS, block, inject
from lakeveil.plans.queries import sanitize


def test_folding_is_guarded_and_changes_what_it_did(spark):
    changed = [*"".join((patterns.CYRILLIC[0], patterns.GREEK[0], patterns.FULLWIDTH[0], patterns.WIDE, patterns.INVISIBLE))]
    rows = [(f"a{c}1",) for c in changed] + [("plain é ÿ\n@1",), ("ж „x“ 中 \U0001f600",), ("",), (None,), ("".join(changed),)]
    frame = spark.createDataFrame(rows, "text string").repartition(2)
    text = F.col("text")
    both = frame.select(patterns.scannable(text).alias("got"), F.translate(patterns.fold(text), patterns.WIDE, "\n" * len(patterns.WIDE)).alias("want"), text)
    found = both.collect()
    assert len(found) == len(rows) and all(r["got"] == r["want"] for r in found) and sum(r["got"] != r["text"] for r in found) == len(changed) + 1
    plan = patterns.with_detections(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "THEN translate(" in plan and "translate(translate(" not in plan


def test_no_whole_text_is_asked_for_scarce_parts(spark):
    frame = spark.createDataFrame([("PAN ABCPE1234F\nno digits\n12 34",), ("x 1\n@",), ("none",)], "text string").repartition(2)
    found = patterns.with_detections(frame)
    assert sorted(len(r["detections"]) for r in found.collect()) == [0, 0, 1]
    asked = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(__folded" in asked.replace("#", "") and not any("__folded" in part[:20] and patterns.PROMISING[:12] in part[:40] for part in asked.split("RLIKE(")[1:])


def texts(spark):
    rows = [(k, None if k == 5 else f"order {k} and {BLOCKS[k % len(BLOCKS)][1]} again\nABCPE1234F here\n") for k in range(30)] + [(None, "x"), (7, "same id")]
    return inject(spark.createDataFrame([(k, 0, t) for k, t in rows], "session_id bigint, unit_seq int, text string").repartition(3))


def test_judged_lines_are_those_of_whole_texts(spark, monkeypatch):
    units, seen = texts(spark), []
    truth = units.select(F.col("session_id").alias("name"), F.lit("injected").alias("id"), block(F.col("session_id"), 2).alias("kind"), block(F.col("session_id"), 1).alias("value")).withColumn("redact", F.col("kind").isNotNull())
    whole = sanitize(units)[0].select(F.col("session_id").alias("name"), F.lit("injected").alias("id"), F.element_at(F.split("text", "\n"), -1).alias("text"))
    told = lambda frame: sorted(((r["name"] if r["name"] is not None else -1, r["value"] or "", r["redact"], r["outcome"]) for r in frame.collect()))
    want = told(score.outcomes(truth, whole))
    real = vault.apply_tokens
    monkeypatch.setattr(vault, "apply_tokens", lambda units, *rest: seen.append(units) or real(units, *rest))
    assert told(field_queries.judged(units)) == want and {"tp", "tn"} <= {o for *_, o in want}
    assert seen[0].agg(F.max(F.length("text"))).first()[0] <= max(len(f"{a}: {b}") for a, b, _ in BLOCKS)


def test_payloads_detect_once(spark, tmp_path):
    rows = [(1, 0, "user", "my PAN is ABCPE1234F"), (1, 1, "assistant", None), (1, 1, "user", "again ABCPE1234F"), (1, 1, "user", "again ABCPE1234F"), (None, 0, "user", "call 9876543210"), (2, None, "user", "999999999999")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = field_queries.r9_payloads(spark, str(tmp_path))
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    payloads = {r["session_id"]: r["payload"] for r in found.collect()}
    assert set(payloads) == {1, 2, None} and payloads[1].count("<PII_PAN_1>") == 3 and "ABCPE1234F" not in "".join(payloads.values())
