"""The element tree, what is said about elements, secrets in texts, the sanitize plan and operators that had no case."""

import html.parser

import pytest
from pyspark.sql import functions as F

from lakeveil.operators import actions, audit, elements, names, pages, redaction, regions, runs, sanitize, search, tree, vault
from lakeveil.operators.fields import SIGNALS, signals
from lakeveil.plans import page_holdout, score

TREES = [
    ("<ul><li>1<li>2<ul><li>3</ul>x</ul>", [("ul", None, ""), ("li", "ul", "1"), ("li", "ul", "2x"), ("ul", "li", ""), ("li", "ul", "3")]),
    ("<p>a<p>b<div>c</div>d", [("p", None, "a"), ("p", None, "b"), ("div", None, "c"), ("body", None, "d")]),
    ("<dl><dt>A<dd>B<dt>C</dl>", [("dl", None, ""), ("dt", "dl", "A"), ("dd", "dl", "B"), ("dt", "dl", "C")]),
    ("<table><tr><td>1<td>2<tr><td>3</table>z", [("table", None, ""), ("tr", "table", ""), ("td", "tr", "1"), ("td", "tr", "2"), ("tr", "table", ""), ("td", "tr", "3"), ("body", None, "z")]),
    ("<div>a</span>b</div>", [("div", None, "ab")]), ("<p>a<b>c<p>d</b>e", [("p", None, "a"), ("b", "p", "c"), ("p", None, "de")]), ("<select><option>1<option>2</select>", [("select", None, ""), ("option", "select", "1"), ("option", "select", "2")]),
    ("a &lt; b &amp; <i>c</i>&nbsp;d", [("body", None, "a < b & d"), ("i", "body", "c")]), ("<p>x < 5 and y > 3</p>", [("p", None, "x < 5 and y > 3")]), ("<svg><path/><text>t</text></svg>", [("svg", None, ""), ("path", "svg", ""), ("text", "svg", "t")]),
    ("", []), ("</p></td>", []), ("<script>var x = '<p>'</script><style>p{}</style>", []), ("<script>never ended <p>", []), ("<!-- <p> --><p>", [("p", None, "")]),
]


@pytest.mark.parametrize("page, want", TREES)
def test_implied_and_crossed_ends(page, want):
    assert [(e.tag, e.parent.tag if e.parent else None, tree._text(e.own).replace(" ", " ")) for e in tree.read(page)] == want


def test_intervals_nest_and_deep_pages_are_linear():
    found = tree.read("<div>" * 20_000 + "x" + "<p>y</p>" * 20_000)
    assert len(found) == 40_000 and max(e.depth for e in found) == 20_000
    for e in tree.read("<div><p>a<p>b<ul><li>c<li>d</ul></div><span>e"):
        assert e.parent is None or (e.parent.seq < e.seq and e.end <= e.parent.end)


class Plain(html.parser.HTMLParser):
    """Own texts by tag of simple pages, by the standard library's tokenizer and its own stack."""

    def __init__(self):
        super().__init__()
        self.stack, self.own = [], []

    def handle_starttag(self, tag, attrs):
        while self.stack and (self.stack[-1][0] == "p" and tag in tree.ENDS_P or tag == "p" and any(t == "p" for t, _ in self.stack)) and any(t == "p" for t, _ in self.stack):
            self.stack.pop()
        self.own.append([tag, ""])
        if tag not in tree.VOID:
            self.stack.append((tag, len(self.own) - 1))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] not in ("script", "style"):
            self.own[self.stack[-1][1]][1] += data


def test_own_text_is_that_of_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for (page,) in rows:
        other = Plain()
        other.feed(page)
        other.close()
        want = [(t, " ".join(x.split())) for t, x in other.own if t not in ("script", "style")]
        assert [(e.tag, " ".join(tree._text(e.own).split())) for e in tree.read(page)] == want


SHOP = """<body><div hidden><section><div>secret ABCPE1234F</div><input id=h value=x></section></div><form action="//evil.example/x"><fieldset><legend>Size</legend>
<input type=radio id=small name=size value=s> <label for=small>Small <b>one</b></label></fieldset><span id=a1>First</span><span id=a2>name</span><input id=n aria-labelledby="a2 a1 gone"><a href="/x" id=link>go</a></form>
<table><tr><th>Description<th colspan=2>Numbers<th>Note<tr><td>Order Total<td id=t1>999999999999<td id=t2>5<td id=t3>n</table>
<table><tr><td>Order Number<td id=h1>123456789012<tr><td>Order Total<td id=h2>999999999999</table>
<div role=group aria-label="Legal name"><p><span id=legal>Priya</span></p></div><textarea id=area>typed text</textarea><div style="display:none">gone</div><p id=after>seen</p>
<select id=sel>""" + "".join(f"<option value={k}>Option {k}" for k in range(50)) + "</select>"


def shop(spark, more=()):
    found = tree.elements(spark.createDataFrame([(1, "https://shop.example/a/b?c", SHOP), *more], "page_id long, url string, html string"))
    return found, elements.described(found)


def test_names_contexts_hidden_subtrees_and_forms(spark):
    found, nodes = shop(spark)
    by = {r["attrs"].get("id"): r for r in nodes.collect()}
    assert not any(r["keep"] for r in nodes.where("hidden").collect()) and nodes.where("hidden").count() == 5 and by["h"]["hidden"]
    assert (by["small"]["label"], by["small"]["context_label"]) == ("Small one", "Size") and by["n"]["label"] == "name First"
    assert [by[k]["context_label"] for k in ("t1", "t2", "t3", "h1", "h2", "legal", "after")] == ["Numbers Order Total", "Numbers Order Total", "Note Order Total", "Order Number", "Order Total", "Legal name", None]
    assert by["small"]["cross_origin_form"] and by["n"]["cross_origin_form"] and by["link"]["cross_origin_form"] and not by["area"]["cross_origin_form"] and by["area"]["value"] == "typed text"
    listed = elements.options(found).first()
    assert len(listed["options"]) == 40 and listed["n_options"] == 50
    shown = elements.outline(nodes.where("keep").join(elements.options(found).drop("page_id"), ["page_key", "node_seq"], "left")).first()["outline"]
    assert "ABCPE1234F" not in shown and "(+38 more)" in shown and '[not selected] group: size' in shown and shown.count('"Option') == 12


def test_null_and_repeated_page_ids(spark):
    more = [(None, None, "<p id=x>null page ABCPE1234F</p>"), (1, "https://shop.example/other", "<p><label for=small>Other</label><input id=small></p>"), (7, "u", None), (1, "https://shop.example/other", "<p><label for=small>Other</label><input id=small></p>")]
    _, nodes = shop(spark, more)
    rows = nodes.where("attrs['id'] = 'small'").collect()
    assert sorted(r["label"] for r in rows) == ["Other", "Other", "Small one"]
    assert [(r["page_id"], r["value"]) for r in nodes.where("attrs['id'] = 'x'").collect()] == [(None, "null page ABCPE1234F")]
    kept = elements.budgeted(nodes, most=3, rescued=1).where("within")
    assert kept.where("url like '%other'").count() == 2 and kept.where("page_id is null").count() == 1


TARGETS = [
    ("https://a.b/c/d?e", "//evil.x/y", "https://evil.x/y"), ("https://a.b/c/d?e", "../../up/./x", "https://a.b/up/x"), ("https://a.b/c/d?e#f", "?q=1", "https://a.b/c/d?q=1"), ("https://a.b", "x", "https://a.b/x"), ("https://a.b/c/d?e", "#f", "https://a.b/c/d?e#f"),
    ("https://a.b/c/", " y\n", "https://a.b/c/y"), ("https://a.b/c", "\\\\evil.x\\y", "https://evil.x/y"), ("https://a.b/c", "mailto:x@y", "mailto:x@y"), ("nope", "x", None), ("https://a.b/c/d", "..", "https://a.b/"), (None, "https://z.z/", "https://z.z/"),
]


def test_references_resolve(spark):
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(TARGETS)], "k int, url string, ref string, want string")
    assert [(r["k"], r["got"]) for r in pages.resolved(rows, "url", "ref", "got").orderBy("k").collect()] == [(k, t[2]) for k, t in enumerate(TARGETS)]


def test_secrets_in_long_texts_and_many_blocks(spark, monkeypatch):
    import random

    r = random.Random(1)
    secrets = ["".join(r.choice("abcdefgh 123") for _ in range(r.randint(6, 14))) for _ in range(100)] + ["- - - -", 'say "x"', "ab"]
    text = "".join(r.choice("abcdefghijk lmnop\n") for _ in range(1_000_000))
    text = text[:500_000] + secrets[3].upper().replace(" ", "") + text[500_000:] + secrets[7] + ' say \\"x\\" - - - - '
    known = spark.createDataFrame([(s, k, v) for s in (1, None) for k, v in enumerate(secrets)], "session_id long, k int, value string")
    wire = spark.createDataFrame([(1, text), (None, "ab"), (None, None), (2, text), (None, "ab")], "session_id long, text string")

    def found():
        return sorted(((x["session_id"] or 0, x["secret"]["k"], x["literal"], x["escaped"], x["loose"]) for x in search.found_in(known, wire).collect()))

    def plain(session, body):
        for k, v in enumerate(secrets):
            tight = search.bare(v)
            how = (v in body, v.replace('"', '\\"') != v and v.replace('"', '\\"') in body, len(tight) >= 6 and tight in search.bare(body))
            if any(how):
                yield (session, k, *how)

    want = sorted([*plain(1, text), *plain(0, "ab"), *plain(0, "ab")])
    assert found() == want and len(want) > 4
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "PART", 1000)
    assert found() == want


def test_sweep_leaves_tokens_alone(spark):
    minted = spark.createDataFrame([(1, "PAN", 1, "<PII_PAN_1>", "ABCPE1234F"), (1, "SENSITIVE", 1, "<PII_SENSITIVE_1>", "PII_PAN_2"), (1, "X", 1, "<PII_X_1>", "- - - -")], "session_id long, kind string, n int, token string, value string")
    clean = spark.createDataFrame([(1, "x <PII_PAN_2> abcpe-1234f y PII_PAN_2"), (1, "- - - -"), (1, None), (2, "ABCPE1234F")], "session_id long, text string")
    got = sorted((r["text"] or "") for r in redaction.sweep(clean, minted).collect())
    assert got == ["", "- - - -", "ABCPE1234F", "x <PII_PAN_2> <PII_PAN_1> y <PII_SENSITIVE_1>"]


def test_numbers_of_one_session_are_dense_and_in_order(spark):
    found = spark.range(100_000).selectExpr("cast(null as long) as session_id", "cast(id as int) as unit_seq", "0 as start", "if(id % 3 = 0, 'PAN', 'CARD') as kind", "concat('v', id % 50000) as value")
    rows = vault.mint(found).orderBy("kind", "n").collect()
    assert len(rows) == 50_000 and [r["n"] for r in rows if r["kind"] == "CARD"] == list(range(1, 1 + sum(r["kind"] == "CARD" for r in rows)))
    assert [int(r["value"][1:]) for r in rows if r["kind"] == "PAN"] == sorted(int(r["value"][1:]) for r in rows if r["kind"] == "PAN")


def lists(spark):
    words = lambda listed: spark.createDataFrame([(w,) for w in listed.split()], "word string")
    return names.gazetteer(words("rajesh ananya sunita meera arjun deepa harsh"), words("sharma verma kulkarni"), words("please reach the called wrote about today desk"))


def units(spark, rows):
    frame = spark.createDataFrame(rows, "session_id long, unit_seq int, field string, text string, tag string, label string")
    return frame.withColumn("signals", F.when(F.col("tag").isNotNull(), signals(tag=F.col("tag"), label=F.col("label"))).otherwise(F.lit(None).cast(SIGNALS)))


def test_one_plan_withholds_fields_names_and_what_stands_elsewhere(spark):
    rows = [
        (1, 0, "value", "ABCPE1234F", "input", "PAN"), (1, 0, "label", "PAN", "input", "PAN"), (1, 1, "value", "Please reach Rajesh Sharma about abcpe-1234f today", "p", None), (1, 2, "value", "opensesame", "input", "Payment PIN"), (1, 3, "context", "ABCPE1234F", "p", None),
        (1, 3, "value", "999999999999", "td", "Order Total"), (1, 4, "title", "Page of Rajesh Sharma", None, None), (1, 5, "value", None, "p", None), (None, 0, "value", "call +91 98765 43210", "p", None), (None, 0, "value", "call +91 98765 43210", "p", None), (2, 0, "value", "say <PII_PAN_9>", "p", None),
    ]
    done = sanitize.sanitize(units(spark, rows), lists(spark))
    got = sorted((r["session_id"] or 0, r["unit_seq"], r["field"], r["text"]) for r in done.units.collect() if r["text"] is not None)
    assert got == [
        (0, 0, "value", "call <PII_PHONE_1>"), (0, 0, "value", "call <PII_PHONE_1>"), (1, 0, "label", "PAN"), (1, 0, "value", "<PII_PAN_1>"), (1, 1, "value", "Please reach <PII_NAME_1> about <PII_PAN_1> today"), (1, 2, "value", "<PII_PASSWORD_1>"), (1, 3, "value", "999999999999"), (1, 4, "title", "Page of <PII_NAME_1>"), (2, 0, "value", "say <PII\\_PAN_9>"),
    ]
    assert done.units.count() == len(rows) and "value" not in done.units.columns
    assert [(r["unit_seq"], r["kind"], r["reason"]) for r in done.kept.collect()] == [(3, "AADHAAR", "commercial-field:AADHAAR")]
    assert {(r["session_id"], r["unit_seq"], r["field"], r["token"]) for r in done.swept.collect()} == {(1, 1, "value", "<PII_PAN_1>"), (1, 4, "title", "<PII_NAME_1>")}
    assert audit.leaks(done.vault, done.units).count() == 0 and not spark._jsc.getPersistentRDDs()
    told = {r["session_id"]: r["payload"] for r in sanitize.payloads(done, spark.createDataFrame([(1, "https://a.b", "shop")], "session_id long, origin string, goal string")).collect()}
    assert set(told) == {1, 2, None} and '"origin":"https://a.b"' in told[1] and '"source":"dom","confidence":1.0' in told[1] and "Rajesh" not in told[1]


def test_a_page_about_many_people_keeps_their_names(spark):
    people = "Rajesh Sharma, Ananya Verma, Sunita Kulkarni, Meera Sharma, Arjun Verma, Deepa Kulkarni and Harsh Sharma"
    prose = people + " wrote about the desk today and called the desk about it, please, today and the day after."
    rows = [(1, 0, "value", prose, "p", None), (1, 1, "value", "Rajesh Sharma", "dd", "Full Name"), (2, 0, "value", prose[: prose.index(", Deepa")] + " wrote about the desk, and called the desk about it again today, please.", "p", None)]
    done = sanitize.sanitize(units(spark, rows), lists(spark), swept=False)
    got = {(r["session_id"], r["unit_seq"]): r["text"] for r in done.units.collect()}
    assert got[1, 0] == prose and got[1, 1] == "<PII_NAME_1>" and got[2, 0].count("<PII_NAME_") == 5
    assert {r["reason"].split(":")[0] for r in done.kept.where("session_id = 1").collect()} == {"page-of-many-names"}
    density = names.prose_names(names.with_names(units(spark, rows).where("session_id = 1"), lists(spark))).first()
    assert (density["names"], density["blocks"], density["reference"]) == (7, 1, True)


def test_blocks_are_spliced_before_the_last_body_end(spark):
    rows = [(0, "u", "<body><p>a</body> b </BODY> c"), (1, "u", "cut"), (2, "u", None), (None, "u", "x"), (None, "u", None)]
    got = {r["page_id"]: r["html"] for r in page_holdout.spliced(spark.createDataFrame(rows[:4], "page_id long, url string, html string")).collect()}
    own = [page_holdout.markup(b) for b in page_holdout.BLOCKS]
    assert got == {0: f"<body><p>a</body> b {own[0]}</BODY> c", 1: f"cut{own[1]}", 2: own[2], None: "x"}
    assert page_holdout.truth(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 12


def test_contacts_counts_and_planted_values(spark):
    found = spark.createDataFrame([(1, "EMAIL", True), (1, "EMAIL", False), (None, "PAN", None)], "session_id long, kind string, org_contact boolean")
    assert sorted((r["session_id"] or 0, r["kind"], r["withheld"], r["org_contacts"]) for r in vault.withheld_counts(found).collect()) == [(0, "PAN", 1, 0), (1, "EMAIL", 1, 1)]
    planted = spark.createDataFrame([(None, "leaky"), (None, "gone"), (1, "minted"), (1, "never")], "session_id long, value string")
    raw = spark.createDataFrame([(None, "leaky and gone"), (1, "minted")], "session_id long, text string")
    clean = spark.createDataFrame([(None, "leaky and"), (1, "<PII_X_1>")], "session_id long, text string")
    minted = spark.createDataFrame([(1, "minted")], "session_id long, value string")
    assert {r["value"]: r["outcome"] for r in score.planted_account(planted, raw, clean, minted).collect()} == {"leaky": "LEAKED", "gone": "pruned", "minted": "redacted", "never": "not extracted"}


def test_page_verdicts_captures_and_opaque_documents(spark):
    rows = [(True, 0.0, 9, 0, 0), (False, 0.9, 9, 0, 0), (False, None, 2, 0, 0), (False, 0.0, 9, 0, 1), (False, 0.9, 9, 3, 1), (False, 0.1, 9, 0, 0)]
    frame = spark.createDataFrame(rows, "opaque boolean, blind_ratio double, nodes int, withheld int, org_contacts int")
    assert [r["verdict"] for r in elements.page_verdict(frame).collect()] == ["opaque", "blind", "blind", "org-contact-only", "3 values", "clean"]
    assert elements.stable_captures(spark.createDataFrame([("a", "a"), ("a", "b"), (None, None)], "before string, after string")).count() == 2
    docs = spark.createDataFrame([("application/pdf", None), ("text/html", "<p>"), (None, '<embed type="application/pdf">'), (None, None)], "t string, h string")
    assert [r[0] for r in docs.select(elements.opaque(F.col("t"), F.col("h"))).collect()] == [True, False, True, False]


def test_contexts_boxes_and_whole_tokens(spark):
    rows = spark.createDataFrame([("context", "<PII_PAN_1> <PII_X_2>"), ("context", "a <PII_PAN_1>"), ("value", "<PII_PAN_1>")], "field string, text string")
    assert [r["text"] for r in redaction.drop_bare_context(rows).collect()] == [None, "a <PII_PAN_1>", "<PII_PAN_1>"]
    own = spark.createDataFrame([(1, 0, True, (1.0, 2.0, 3.0, 4.0)), (1, 1, True, (1.0, 2.0, 3.0, 4.0)), (1, 2, True, (0.0, 0.0, 0.0, 4.0)), (1, 3, False, (9.0, 9.0, 9.0, 9.0)), (1, 4, True, (5.0, 5.0, 5.0, 5.0))], "session_id long, unit_seq int, visible boolean, box struct<x:double,y:double,w:double,h:double>")
    hit = spark.createDataFrame([(1, k) for k in range(4)], "session_id long, unit_seq int")
    assert [tuple(r) for r in redaction.boxes(own, hit).collect()] == [(1, 1.0, 2.0, 3.0, 4.0)]
    asked = spark.createDataFrame([(1, "<PII_PAN_1>"), (1, " <PII_PAN_9> "), (1, "see <PII_PAN_1>"), (1, None)], "session_id long, text string")
    known = spark.createDataFrame([(1, "<PII_PAN_1>", "v")], "session_id long, token string, value string")
    assert [(r["value"], r["status"]) for r in vault.resolve_tokens(asked, known).orderBy(F.col("text").asc_nulls_last(), "status").collect()] == [(None, "unknown token"), ("v", "ok"), (None, "literal"), (None, "literal")]


def test_boxes_masks_images_and_their_labels(spark):
    box = F.struct(F.lit(10.0).alias("x"), F.lit(2.0).alias("y"), F.lit(8.0).alias("w"), F.lit(4.0).alias("h"))
    size = lambda w: F.struct(F.lit(w).cast("double").alias("w"), F.lit(w).cast("double").alias("h"))
    row = spark.range(1).select(regions.scale(box, size(500.0), size(1000.0)).alias("s"), regions.scale(box, size(None), size(1000.0)).alias("n"), regions.likely_person(regions.softmax_top(F.array(F.lit(0.0), F.lit(3.0))), [1]).alias("p"), regions.likely_person(regions.softmax_top(F.array(F.lit(0.0), F.lit(9.0))), [0]).alias("q")).first()
    assert tuple(row["s"]) == (20.0, 4.0, 16.0, 8.0) and tuple(row["n"]) == (10.0, 2.0, 8.0, 4.0) and row["p"] and not row["q"]
    crops = spark.createDataFrame([(1, k, (0.0, 0.0, 24.0, 24.0 if k != 3 else 23.0)) for k in range(20)], "page_id long, node_seq int, box struct<x:double,y:double,w:double,h:double>")
    assert regions.eligible(crops).count() in (11, 12)
    flags = spark.createDataFrame([(True, False, 3), (False, True, 3), (False, False, 0), (None, None, 2)], "unreadable boolean, beyond_cap boolean, queue int")
    assert [r["decision"] for r in regions.image_decision(flags).collect()] == ["withhold", "withhold", "skip", "masked"]
    nodes, seen = spark.createDataFrame([(1, 1), (1, 2)], "page_id long, node_seq int"), spark.createDataFrame([(1, 2, "cat", 0.5, False)], "page_id long, node_seq int, image_label string, confidence double, likely_person boolean")
    assert sorted((r["node_seq"], r["image_label"]) for r in regions.annotate(nodes, seen).collect()) == [(1, None), (2, "cat")]
    asked, done = (spark.createDataFrame([(k,) for k in ids], "image_id long") for ids in ([1, 1, 2, 3], [1, 1, 2, 2]))
    assert {r["image_id"]: r["send"] for r in regions.complete(asked, done).collect()} == {1: True, 2: True, 3: False}


def test_two_channels(spark):
    rows = lambda ids: spark.createDataFrame([(k,) for k in ids], "session_id long")
    got = {r["session_id"]: r["verdict"] for r in audit.channels(rows([1, 1, 2, None]), rows([1, None]), rows([1, 2, 3, None])).collect()}
    assert got == {1: "covered", 2: "uncovered", 3: "nothing to cover", None: "covered"}


def test_logs(spark):
    log = spark.createDataFrame([('{"kind":"click","target":"el_1","reasoning":"r"}',), ('{"kind":"type","target":"el_1","reasoning":"r"}',), ('{"kind":"fly","reasoning":"r"}',), ("no json",), (None,)], "raw string")
    assert [r["conforms"] for r in actions.parsed(log).collect()] == [True, False, False, False, False]
    done = spark.createDataFrame([(1, 0, 0, True, None, "go"), (1, 0, 1, False, "target-hidden:x", "try"), (1, 0, 2, False, "target-hidden:x", None)], "run_id long, turn int, idx int, allowed boolean, reason string, reasoning string")
    assert {(r["allowed"], r["actions"]) for r in actions.report(done).collect()} == {(True, 1), (False, 2)}
    assert [r["line"] for r in runs.history(done).orderBy("idx").collect()] == ["go", "REFUSED (target-hidden:x) try", "REFUSED (target-hidden:x) "]
    ids = lambda rows: spark.createDataFrame(rows, "page_id long, id string")
    assert [r["id"] for r in actions.still_missing(ids([(1, "a"), (1, "b")]), ids([(1, "b"), (1, "c")])).collect()] == ["b"]
    turns = spark.createDataFrame([(1, 10.0, 30.0), (1, 10.0, 50.0)], "run_id long, extract double, network double")
    assert {r["stage"]: (r["ms"], r["share"]) for r in runs.stage_breakdown(turns, ["extract", "network"]).collect()} == {"extract": (20.0, 0.2), "network": (80.0, 0.8)}
    talk = spark.createDataFrame([(1, 1, "a", 2, "ask-user", "Which?"), (1, 2, "b", 1, "done", None), (2, 1, "c", 0, "ask-user", "Who?")], "thread_id long, at int, summary string, withheld int, reason string, question string")
    folded = {r["thread_id"]: (r["status"], r["pending"], [t["summary"] for t in r["turns"]], r["withheld"]) for r in runs.fold_threads(talk).collect()}
    assert folded[1][0] == "done" and folded[1][2:] == (["a", "b"], 3) and folded[2] == ("open", "Who?", ["c"], 0)
    visits = spark.createDataFrame([("chrome://x", "https://a.b"), ("https://a.b/x", "https://a.b"), ("https://c.d/x", "https://a.b"), ("https://e.f", "https://a.b")], "url string, active_origin string")
    known = spark.createDataFrame([("https://c.d",)], "origin string")
    assert {r["url"]: r["verdict"] for r in runs.thread_verdicts(visits, known).collect()} == {"chrome://x": "internal", "https://a.b/x": "continue", "https://c.d/x": "resume", "https://e.f": "new"}
    asked = spark.createDataFrame([(1, "el_1"), (1, "el_2")], "run_id long, node_id string")
    nodes = spark.createDataFrame([(1, 2, "el_1", "later"), (1, 1, "el_1", "first"), (1, 0, "el_1", None)], "run_id long, turn int, node_id string, label string")
    assert {r["node_id"]: r["label"] for r in runs.question_labels(asked, nodes).collect()} == {"el_1": "first", "el_2": None}


def test_scores_that_had_no_case(spark):
    truth = spark.createDataFrame([("a", ["bad", "fine"]), ("b", ["bad"])], "name string, mustNotFind array<string>")
    wire = spark.createDataFrame([("a", "so bad"), ("b", "good")], "name string, text string")
    assert [tuple(r) for r in score.forbidden(truth, wire).collect()] == [("a", "bad")]
    judged = lambda *o: spark.createDataFrame([(x,) for x in o], "outcome string")
    assert {r["names"]: (r["recall"], r["precision"]) for r in score.ablation(judged("tp", "tp", "tn"), judged("tp", "fn", "fp")).collect()} == {True: (1.0, 1.0), False: (0.5, 0.5)}
    ok = spark.createDataFrame([(399_999, 0, 1), (400_000, 0, 1), (10, 1, 1), (10, 0, 0)], "payload_bytes int, leaks int, controls int")
    assert [r[0] for r in ok.select(score.survives(None)).collect()] == [True, False, False, False]
    clean = spark.createDataFrame([(1, 3, "x <PII_PAN_1>"), (1, 1, "<PII_PAN_1>"), (2, 0, "<PII_PAN_1>")], "session_id long, unit_seq int, text string")
    kept = score.kept_values(clean, spark.createDataFrame([(1, "<PII_PAN_1>", "PAN", "v")], "session_id long, token string, kind string, value string")).collect()
    assert [(r["session_id"], r["unit_seq"], r["value"]) for r in kept] == [(1, 1, "v")]
    budget = spark.createDataFrame([(1, True)] * 5 + [(2, True)] * 2 + [(2, False)] * 9, "page_id long, within boolean")
    assert [(r["page_id"], r["nodes"]) for r in score.over_budget(budget, most=4).collect()] == [(1, 5)]
    two = [("t", None, "label"), ("u", "<PII_NAME_1>", "<PII_NAME_2>")]
    nodes = spark.createDataFrame([(1, k, {"id": i}, v, lab, None) for k, (i, v, lab) in enumerate(two)], "page_id long, node_seq int, attrs map<string,string>, value string, label string, context_label string")
    asked = spark.createDataFrame([(1, "t", "PAN", True), (1, "u", "NAME", True), (1, "v", None, False)], "page_id long, id string, kind string, redact boolean")
    assert {r["id"]: (r["outcome"], r["kept_context"]) for r in score.page_outcomes(asked, nodes).collect()} == {"t": ("fn", False), "u": ("tp", False), "v": ("ignored", False)}
