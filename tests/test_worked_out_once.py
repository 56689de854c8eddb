"""What is costly is worked out once a row: filters on it are not put in terms of what it is made of."""

from pyspark.sql import functions as F

from lakeveil.operators import elements, patterns, textstats, tree


def filters(frame):
    """The conditions of an optimized plan's filters."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")]


def test_a_filter_on_detections_detects_nothing_anew(spark):
    units = spark.createDataFrame([(1, 0, "AB​CPE1234F АBCPE1234F and ABCPE１２３４F"), (1, 1, None)], "session_id bigint, unit_seq int, text string").repartition(2)
    found = patterns.with_detections(units).where(F.size("detections") > 0)
    assert filters(found) and not any("translate" in f or "RLIKE" in f for f in filters(found))
    assert [(d["kind"], d["start"], d["end"]) for r in found.collect() for d in r["detections"]] == [("PAN", 0, 11), ("PAN", 12, 22), ("PAN", 27, 37)]


def test_elements_are_described_without_a_join_or_a_shuffle(spark):
    page = '<form action=" /go "><label for="a">Pay <b>to</b></label><input id="a"><p id="x">one</p><p id="y" hidden>two</p><i aria-labelledby="y x"></i><table><tr><th>Head</th><th>Col</th></tr><tr><td>r</td><td>v</td></tr></table><div aria-label=" some  group "><span>s</span></div></form>'
    found = elements.described(tree.elements(spark.createDataFrame([(1, "https://a.test/", page)] * 2, "page_id long, url string, html string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = [(r["tag"], r["label"], r["value"], r["context_label"]) for r in found.collect()]
    for want in [("input", "Pay to", None, "Pay"), ("i", "two one", None, None), ("td", None, "v", "Col r"), ("span", None, "s", "some group")]:
        assert rows.count(want) == 2, (want, rows)


def test_burstiness_at_its_bounds_is_told_in_whole_numbers(spark):
    # Mean 20: deviation 9 is 0.45 of it, as rounded as 0.44999999999999996 or not; 5 is 0.25 of it; 0 without sentences.
    rows = [(1, 2, 40, 962), (2, 2, 40, 850), (3, 2, 40, 852), (4, None, None, None), (5, 3, 60, 1443), (6, 3, 60, 1442)]
    stats = spark.createDataFrame(rows, "id int, sentences bigint, sum_len bigint, sum_squares bigint").selectExpr("*", "sqrt(sum_squares / sentences - 400) - 1e-12 as sd_len", "20.0D as mean_len", "0L as em", "9L as words", "0L as opener_count", "0L as ellipsis", "0L as tells")
    assert {r["id"]: r["burstiness_band"] for r in textstats.verdict(stats).collect()} == {1: "PASS", 2: "FLAG", 3: "MID", 4: "FLAG", 5: "PASS", 6: "MID"}
