"""Cases of fields, redaction, names, pages, actions, runs, regions and streams."""

import pytest
from pyspark.sql import functions as F

from lakeveil.operators import actions, elements, fields, names, redaction, regions, runs, tree, vault
from lakeveil.plans import score
from lakeveil.streaming import streams

# value, tag, label, type, kind that the token names (None: left as it is)
VALUES = [
    ("4540 2012 2334", "input", "Search", None, "AADHAAR"), ("4540-2012-2334", "input", "Search", None, "AADHAAR"), ("454020122334", "input", "Search", None, "SENSITIVE"), ("496402120001084", "input", "Account Number", None, "BANK_ACCOUNT"),
    ("496402120001084", "input", "Search", None, "SENSITIVE"), ("4111 1111 1111 1111", "input", "Search", None, "CARD"), ("ABCPE1234F", "input", "Search", None, "PAN"), ("999999999999", "td", "Order Total", None, None),
    ("hunter2", "input", "Login", "password", "PASSWORD"), ("22 Rashbehari Avenue", "dd", "Address", None, "ADDRESS"), ("ABCPE1234F", "input", "PAN/ Aadhaar/ Other User ID", None, "PAN"), ("plain words", "p", None, None, None),
    ("123456789012", "input", "Application number", None, None), ("ABCPE1234F", "dd", "PAN (for invoices)", None, "PAN"),
]


def test_values_and_their_tokens(spark):
    rows = spark.createDataFrame([(k, 0, *v[:4]) for k, v in enumerate(VALUES)], "session_id long, unit_seq int, text string, tag string, label string, type string")
    units = rows.withColumn("field", F.lit("value")).withColumn("signals", fields.signals(tag=F.col("tag"), label=F.col("label"), type=F.col("type")))
    decided = redaction.decide(units)
    got = {r["session_id"]: [s["kind"] for s in r["spans"]] for r in decided.collect()}
    assert got == {k: [v[4]] if v[4] else [] for k, v in enumerate(VALUES)}
    kept = {r["session_id"]: r["reason"] for r in redaction.acknowledged(decided, "session_id").collect()}
    assert "commercial" in kept[7] and set(kept) == {7} or set(kept) <= {7, 12}
    found = vault.occurrences(decided, spans="spans")
    clean = {r["session_id"]: r["text"] for r in vault.apply_tokens(units, found, vault.mint(found)).collect()}
    assert clean[3] == "<PII_BANK_ACCOUNT_1>" and clean[7] == "999999999999"


def test_labels_only_lose_what_stands_in_them(spark):
    rows = spark.createDataFrame([(1, 0, "label", "Aadhaar Number"), (1, 1, "label", "PAN ABCPE1234F"), (1, 2, "context", "Total 999999999999")], "session_id long, unit_seq int, field string, text string")
    units = rows.withColumn("signals", fields.signals(tag=F.lit("input"), label=F.col("text")))
    got = {r["unit_seq"]: [s["kind"] for s in r["spans"]] for r in redaction.decide(units).collect()}
    assert got == {0: [], 1: ["PAN"], 2: []}


def test_sweep_finds_other_spellings(spark):
    schema = "session_id long, unit_seq int, text string"
    clean = spark.createDataFrame([(1, 0, "a 4111-1111 1111-1111 b and aBcPe1234f"), (2, 0, "4111111111111111"), (None, 0, "x.y(1) z"), (1, 1, None)], schema)
    minted = spark.createDataFrame([(1, "CARD", 1, "<PII_CARD_1>", "4111 1111 1111 1111"), (1, "PAN", 1, "<PII_PAN_1>", "ABCPE1234F"), (None, "NAME", 1, "<PII_NAME_1>", "x.y(1)")], "session_id long, kind string, n int, token string, value string")
    got = sorted(((r["session_id"] or 0, r["unit_seq"]), r["text"]) for r in redaction.sweep(clean.where("text is not null"), minted.withColumn("value", F.replace("value", F.lit(" "), F.lit("")))).collect())
    assert got == [((0, 0), "<PII_NAME_1> z"), ((1, 0), "a <PII_CARD_1> b and <PII_PAN_1>"), ((2, 0), "4111111111111111")]
    assert redaction.sweep(clean, minted).count() == 4


def test_domains_and_contacts(spark):
    hosts = spark.createDataFrame([("www.portal.co.in",), ("a.b.example.com:8080",), ("localhost",)], "h string")
    assert [r[0] for r in hosts.select(fields.registrable_domain(F.col("h"))).collect()] == ["portal.co.in", "example.com", "localhost"]
    rows = spark.createDataFrame([("support@portal.co.in", "p"), ("priya.r@portal.co.in", "p"), ("support@other.org", "p"), ("support@portal.co.in", "input"), ("help+x@www.portal.co.in", "a")], "raw string, tag string")
    assert [r[0] for r in rows.select(fields.is_org_contact(F.col("raw"), fields.signals(tag=F.col("tag")), F.lit("www.portal.co.in"))).collect()] == [True, False, False, False, True]


NAMES = [
    ("Reach Rajesh Sharma today", ["Rajesh Sharma"]), ("Sudipto Chatterjee wrote", ["Sudipto Chatterjee"]), ("New Delhi Road", []), ("Kotak Mahindra Bank Limited", []), ("Ananya Zyxwell called", ["Ananya Zyxwell"]), ("Rajesh. Sharma", []),
    ("यह आवेदन विक्रम शर्मा द्वारा", ["विक्रम शर्मा"]), ("श्री सौरभ विजय आए", ["सौरभ विजय आए"][:0] or ["सौरभ विजय"]), ("भारत सरकार", []), ("lower case only", []), (None, []), ("Rajesh Sharma " * 200, []),
]


def test_names(spark):
    words = lambda listed: spark.createDataFrame([(w,) for w in listed.split()], "word string")
    lists = names.gazetteer(words("rajesh ananya"), words("sharma chatterjee"), words("called wrote today reach road"))
    units = spark.createDataFrame(list(enumerate([t for t, _ in NAMES])), "session_id long, text string")
    got = {r["session_id"]: [n["text"] for n in r["names"] if n["confidence"] >= 0.6] for r in names.with_names(units, lists).collect()}
    assert got == {k: want for k, (_, want) in enumerate(NAMES)}


PAGE = """<html><body><form action="https://other.test/x"><label for="p">PAN number</label><input id="p" name="pan" value="ABCPE1234F" required>
<label>Mail <input type="email" value="a@b.co"></label><select name="c"><option value="1">One</option><option>Two</option></select><input type="radio" name="g" checked><input type=password></form>
<p>Some <b>bold</b> text<div style="display:none">hidden</div><img alt="a long text"><img><h1>Title</h1><!-- no --><script>x < 1</script></body></html>"""


def test_elements(spark):
    found = tree.elements(spark.createDataFrame([(1, "https://site.test/a", PAGE), (2, "u", None)], "page_id long, url string, html string"))
    rows = {r["node_seq"]: r for r in elements.described(found).collect()}
    by = lambda tag: [r for _, r in sorted(rows.items()) if r["tag"] == tag]
    inputs = by("input")
    assert [(r["role"], r["label"], r["value"]) for r in inputs] == [("textbox", "PAN number", "ABCPE1234F"), ("textbox", "Mail", "a@b.co"), ("radio", None, None), ("password", None, None)]
    assert inputs[0]["required"] and inputs[2]["checked"] and not inputs[1]["checked"] and inputs[0]["cross_origin_form"]
    assert rows[inputs[1]["parent_seq"]]["tag"] == "label" and rows[by("option")[0]["parent_seq"]]["tag"] == "select" and rows[by("body")[0]["parent_seq"]]["tag"] == "html"
    assert [r["needs_vision"] for r in by("img")] == [False, True] and [r["hidden"] for r in by("div")] == [True] and by("h1")[0]["label"] == "Title"
    assert [[(o["value"], o["label"]) for o in r["options"]] for r in elements.options(found).collect()] == [[("1", "One"), ("Two", "Two")]]
    kept = elements.budgeted(elements.described(found), most=2, rescued=1)
    assert kept.where("within").count() == 3 and kept.where("truncated").count() == kept.count()
    assert [r["beyond_cap"] for r in elements.beyond_cap(elements.budgeted(elements.described(found), most=1, rescued=0)).collect()] == [True]


def test_action_verdicts(spark):
    node = "page_id long, node_id string, node_seq int, role string, label string, value string, visible boolean, enabled boolean, field_kind string, cross_origin_form boolean, options array<struct<value:string,label:string>>"
    nodes = spark.createDataFrame([(1, "el_1", 1, "textbox", "PAN", "", True, True, "PAN", False, []), (1, "el_2", 2, "button", "Submit", None, True, True, None, False, []), (1, "el_3", 3, "select", "State", "", True, True, None, False, [("KA", "Karnataka")]), (1, "el_4", 4, "textbox", "Name", "<PII_NAME_1>", True, True, "NAME", True, []), (1, "el_5", 5, "textbox", "Off", "", False, True, None, False, []), (1, "el_6", 6, "radio", "Yes", None, True, True, None, False, [])], node)
    tokens = spark.createDataFrame([(1, "<PII_PAN_1>"), (1, "<PII_NAME_1>")], "page_id long, token string")
    cases = [
        ("fly", None, None, None, None, "kind-unknown:fly"), ("type", "el_1", "ABCPE1234F", None, None, "raw-value:PAN"), ("wait", None, None, None, None, None), ("ask_user", None, None, " ", None, "question-empty"), ("answer", None, None, "x", None, None),
        ("scroll", None, None, None, 1e6, "scroll-out"), ("click", None, None, None, None, "target-missing"), ("click", "[el_9]", None, None, None, "target-unknown"), ("click", "el_5", None, None, None, "target-hidden"), ("select", "el_6", "x", None, None, None),
        ("click", "el_3", None, None, None, "wants-select"), ("type", "el_3", "karnataka", None, None, None), ("type", "el_2", "x", None, None, "takes-no-text"), ("type", "el_1", "", None, None, "value-empty"), ("type", "el_1", "<PII_PAN_1>", None, None, None),
        ("type", "el_1", "<PII_PAN_7>", None, None, "token-unknown"), ("type", "el_4", "<PII_NAME_1>", None, None, "token-leaves-site"), ("type", "el_1", "<PII_NAME_1>", None, None, "token-kind:NAME:in:PAN"), ("type", "el_4", "x", None, None, "holds-withheld-value"), ("click", "(el_2)", None, None, None, None),
    ]
    rows = spark.createDataFrame([(k, 0, 0, 1, *c[:5], True) for k, c in enumerate(cases)], "run_id long, turn int, idx int, page_id long, kind string, target string, value string, text string, scroll_delta double, executed boolean")
    got = {r["run_id"]: r for r in actions.validated(rows, nodes, tokens).collect()}
    for k, c in enumerate(cases):
        assert (got[k]["reason"] is None) == (c[5] is None) and (c[5] is None or c[5] in got[k]["reason"]), (c, got[k]["reason"])
    assert got[9]["normalised"] == "click" and (got[11]["normalised"], got[11]["new_value"]) == ("select", "KA") and got[15]["question"] == "What is your PAN?"
    again = spark.createDataFrame([(1, t, 0, 1, "click", "el_2", None, None, None, True) for t in range(3)], rows.schema)
    assert [r["allowed"] for r in actions.validated(again, nodes, tokens).orderBy("turn").collect()] == [True, False, False]
    assert [(r["submit_id"]) for r in actions.submit_candidates(nodes).collect()] == ["el_2"]
    wide = nodes.withColumn("context_label", F.lit(None).cast("string")).withColumn("required", F.lit(True)).withColumn("input_type", F.lit("text")).withColumn("grp", F.lit("g")).withColumn("checked", F.lit(False))
    assert sorted((r["id"], r["kind"]) for r in actions.missing_fields(wide).collect()) == [("el_1", "text"), ("el_6", "choice")]


def test_stop_reasons(spark):
    names_ = ["opaque", "left", "failed", "answered", "asked", "finished", "remedy"]
    turn = lambda run, t, allowed, denied, **on: (run, t, *(n in on for n in names_), allowed, denied)
    rows = [turn(1, 0, 1, 0), turn(1, 1, 1, 0, finished=1), turn(2, 0, 0, 2), turn(2, 1, 0, 1), turn(3, 0, 0, 1, remedy=1), *(turn(4, t, 1, 0) for t in range(5)), turn(5, 0, 1, 0), turn(5, 1, 0, 0, left=1)]
    frame = spark.createDataFrame(rows, "run_id long, turn int, " + ", ".join(f"{n} boolean" for n in names_) + ", allowed int, denied int")
    got = {r["run_id"]: (r["turn"], r["reason"]) for r in runs.stop_reasons(frame).collect()}
    assert got == {1: (1, "done"), 2: (1, "nothing-executable"), 3: (0, "needs-user-input"), 4: (4, "max-turns"), 5: (1, "navigated-away")}


def test_regions(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    rows = spark.createDataFrame([(1, 0.9, (0.0, 0.0, 10.0, 10.0)), (1, 0.8, (1.0, 1.0, 10.0, 10.0)), (1, 0.95, (50.0, 50.0, 5.0, 5.0)), (2, 0.7, (0.0, 0.0, 10.0, 10.0))], f"image_id long, score double, box {box}")
    assert sorted((r["image_id"], r["score"]) for r in regions.thin(rows).collect()) == [(1, 0.9), (1, 0.95), (2, 0.7)]
    one = spark.createDataFrame([(1, 0.9, 0.25, 0.25, 0.75, 0.75, 640, 480), (1, 0.5, 0.1, 0.1, 0.9, 0.9, 640, 480)], "image_id long, score double, x1 double, y1 double, x2 double, y2 double, src_w int, src_h int")
    assert [tuple(r["box"]) for r in regions.decode(one).collect()] == [(160.0, 120.0, 320.0, 240.0)]
    b = F.struct(F.lit(10.0).alias("x"), F.lit(2.0).alias("y"), F.lit(8.0).alias("w"), F.lit(4.0).alias("h"))
    row = rows.limit(1).select(regions.expand(b).alias("e"), regions.mask(b, F.struct(F.lit(15).alias("w"), F.lit(50).alias("h"))).alias("m")).first()
    assert tuple(row["e"]) == (8.0, 1.0, 12.0, 6.0) and tuple(row["m"]) == (8, 0, 7, 8)


def test_score_and_gate(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(tuple(r) for r in score.gate(rows, spark.createDataFrame([("b",), ("c",)], "id string")).collect()) == [("a", "new"), ("c", "stale")]


@pytest.mark.parametrize("late", ["1 hour"])
def test_streams_equal_batches(spark, tmp_path, late):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(folder)
    stream = streams.sessions(spark.readStream.schema(events.schema).parquet(folder), late=late)
    held = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda rows, _: held.extend(tuple(r) for r in rows.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in streams.sessions(events).collect()}
    assert held and set(held) <= want  # the last sessions stay open behind the watermark
    units = spark.createDataFrame([(1, "PAN ABCPE1234F <PII_X_1>"), (2, None)], "id long, text string")
    units.write.parquet(out)
    texts = []
    clean = streams.sanitize_stream(spark.readStream.schema(units.schema).parquet(out), "key")
    clean.writeStream.option("checkpointLocation", str(tmp_path / "d")).foreachBatch(lambda rows, _: texts.extend(r["text"] for r in rows.collect())).trigger(availableNow=True).start().awaitTermination(120)
    shown = [t for t in texts if t][0]
    assert "ABCPE1234F" not in shown and shown.startswith("PAN <PII_PAN_") and "<PII\\_X_1>" in shown and None in texts
