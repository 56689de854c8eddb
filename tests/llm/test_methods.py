"""Methods against plain versions of themselves, and what must stay bounded."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeveil.llm import decontaminate, language, mixing, repeats, secrets, sketch, substrings, suffixes


def test_out_of_place_distance_by_hand(spark):
    texts = ["the cat sat on the mat and the dog", "le chat et la souris sont dans la maison", "xyz xyz"]
    train = spark.createDataFrame([(1, texts[0] * 3, "en"), (2, texts[1] * 3, "fr")], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(train)
    names = sorted(profiles)
    _, score, far = language.nearest(texts, names, np.stack([profiles[n] for n in names]))
    for t, s, f in zip(texts, score, far):
        bins = language.gram_bins(t).tolist()
        mine = sorted(set(bins), key=lambda b: (-bins.count(b), b))[: language.SIZE]
        sums = []
        for n in names:
            theirs = [b for _, b in sorted((r, b) for b, r in enumerate(profiles[n]) if r < language.SIZE)]
            sums.append(sum(abs(theirs.index(b) - k) if b in theirs else abs(language.SIZE - k) for k, b in enumerate(mine)))
        assert f == pytest.approx(min(sums) / (language.SIZE * len(mine))) and s == pytest.approx((max(sums) - min(sums)) / max(sums))


def test_other_scripts_and_unwanted_languages_go(spark):
    rows = [(k, ("the house and the garden of the old town " if k % 2 else "la maison et le jardin de la vieille ville ") * 4, ("fr", "en")[k % 2]) for k in range(40)]
    docs = spark.createDataFrame(rows + [(90, "Это русский текст о погоде и истории", "ru?"), (91, None, "en"), (92, "12 - 14", "en")], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(docs.where("doc_id < 40"))
    assert {r["doc_id"] for r in language.keep_identified(docs, profiles).collect()} == set(range(40))
    assert {r["doc_id"] % 2 for r in language.keep_identified(docs, profiles, languages=("fr",)).collect()} == {0}


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's active sets: a solver that shares nothing with the operator's."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    while (~free).any() and slope[~free].max() > 1e-10:
        free[np.where(~free, slope, -np.inf).argmax()] = True
        while True:
            s = np.zeros(len(x))
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                break
            out = free & (s <= 0)
            x = x + (x[out] / (x[out] - s[out])).min() * (s - x)
            free &= x > 1e-12
        x, slope = s, a.T @ (b - a @ s)
    return x


@pytest.mark.parametrize("reachable", [True, False])
def test_totals_are_those_of_an_independent_solver(spark, reachable):
    r = np.random.default_rng(4)
    p = r.dirichlet([3.0, 1.0, 1.0], 300)
    p = p if reachable else 0.6 * p + 0.4 * np.array([0.4, 0.3, 0.3])
    tokens = r.integers(1, 300, 300)
    goal = np.array([0.5, 0.3, 0.2]) if reachable else np.array([0.9, 0.05, 0.05])
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, posterior array<double>")
    steps, found = mixing.fit_rates(members, goal.tolist())
    got = np.array([x["rate"] for x in members.select(mixing.rate(steps).alias("rate")).collect()])
    share = tokens[:, None] * p / tokens.sum()
    root = np.linalg.cholesky(np.linalg.inv(p.T @ share + np.eye(3) * 1e-6)).T
    best = root @ (share.T @ nonnegative_least_squares(root @ share.T, root @ goal) - goal)
    assert got.min() >= 0 and np.allclose(got @ share, found.reached, atol=1e-9)
    assert (np.abs(best).max() < 1e-6) == reachable and found.ended == ("on target" if reachable else "out of reach")
    assert found.least_off <= np.linalg.norm(best) + 1e-6 and found.off == pytest.approx(np.linalg.norm(root @ (found.reached - goal)))
    if not reachable:
        assert 0.9 * np.linalg.norm(best) <= found.least_off and found.off <= 1.4 * np.linalg.norm(best)
    assert mixing.fit_rates(members, goal.tolist(), most_steps=0)[1].ended == "unsettled"


def test_calibration_finds_the_odds():
    r = np.random.default_rng(2)
    score = r.normal(size=(4000, 1)) * 3
    x = np.c_[score, -score, np.ones((4000, 1))]
    p = 1 / (1 + np.exp(-(2 * score[:, 0] - 1)))
    w = mixing.calibrated(x, (r.random(4000) > p).astype(int), [np.log(0.5)] * 2)
    z = np.c_[x, np.ones(4000)] @ w.T
    assert np.abs(1 / (1 + np.exp(z[:, 1] - z[:, 0])) - p).max() < 0.06


def test_totals_are_told(spark):
    docs = spark.createDataFrame([(k, "aa bb" if k % 2 else "cc dd") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "odd" if k % 2 else "even") for k in range(200)], "doc_id long, domain string")
    row = mixing.mix(docs, labels, {"odd": 0.7, "even": 0.3}).selectExpr("reached", "on_target").collect()
    assert row[0]["on_target"] and abs(row[0]["reached"]["odd"] - 0.7) < 2e-3


def test_long_and_short_items(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    long = [word() for _ in range(20_000)]
    items = [(1, " ".join(long)), (2, "three short words"), (3, "hello"), *((k, " ".join(word() for _ in range(12))) for k in range(10, 60))]
    changed = list(long)
    changed[5000:5010] = ["zz"] * 4
    texts = [(1, "before " + " ".join(changed) + " after"), (2, "say Three  Short words now"), (3, "three shorter words"), (4, "HELLO"), (5, "hello-x"), (6, items[20][1])]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["distance"], x["item_words"]) for x in decontaminate.find_items(docs, bench).collect()}
    assert got == {(1, 1): (10, 20_000), (2, 2): (0, 3), (4, 3): (0, 1), (6, items[20][0]): (0, 12)}
    parts = list(decontaminate.batches_by_length(np.array([12] * 5000 + [20_000, 3, 3])))
    assert sorted(np.concatenate(parts).tolist()) == list(range(5003)) and any(len(p) == 1 for p in parts)


@pytest.mark.parametrize("module, gone", [(substrings, 50), (suffixes, 100)])
def test_copies_of_a_row_cost_in_proportion(spark, module, gone, monkeypatch):
    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    sizes = []
    own = repeats.by_row

    def counted(found, *columns):
        out = own(found, *columns)
        sizes.append(out.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0])
        return out

    for m in (repeats, module):
        monkeypatch.setattr(m, "by_row", counted)
    docs = spark.createDataFrame([(d, text) for d in (1, 2) for _ in range(40)] + [(None, text)] * 5, "doc_id long, text string")
    removed = {(x["doc_id"], x["n_removed"]) for x in module.drop_repeats(docs).collect()}
    whole = 120 if gone == 50 else len(text)
    assert removed == {(1, 0), (2, whole), (None, whole)}
    assert max(sizes) <= len(text)


@pytest.mark.parametrize("module", [substrings, suffixes])
def test_a_tabled_sketch_gives_the_same(spark, module, monkeypatch):
    r = random.Random(6)
    passage = " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(60))
    docs = spark.createDataFrame([(k, " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(90)) + (" " + passage if k % 3 == 0 else "")) for k in range(30)], "doc_id long, text string")
    want = sorted(tuple(x) for x in module.drop_repeats(docs).drop("kept").collect())
    monkeypatch.setattr(repeats, "MOST_BITS", 8)
    assert sorted(tuple(x) for x in module.drop_repeats(docs, bits=20).drop("kept").collect()) == want and any(x[2] for x in want)


def test_sketch_blocks_of_any_size(spark):
    import pyarrow as pa

    frame = spark.range(2000).selectExpr("id % 1500 as k")
    keys = lambda b: [pa.compute.cast(b.column(0), pa.uint64()).to_numpy() * np.uint64(0x9E3779B97F4A7C15)]
    for bits in (12, 24):
        found = sketch.repeated_bits(frame, keys, bits)
        all_keys = np.arange(1500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert sketch.at_least_two(found, all_keys[:500], bits).all()
        assert bits == 12 or sketch.at_least_two(found, all_keys[500:], bits).sum() < 50


def secret_texts(n, seed, plant):
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, want = [], []
    for k in range(n):
        words = " ".join(pick("abcdefghijklmnop", r.randint(2, 9)) for _ in range(30))
        path = "/" + "/".join(pick("abcdefghij", 6) for _ in range(4))
        rule = f"token = {pick('0123456789abcdef', 32)}" if k % 2 else f"password: {pick(alnum, 24)}"
        # Three kinds that the network is shown none of: groups of capitals and digits, words of letters and digits between plus signs, a long prefix with two rulers.
        planted = ["-".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 6) for _ in range(5)), "svcacct__" + pick(alnum, 30), "+".join(pick(alnum, 11) for _ in range(3))][k % 3]
        rows.append((seed * 10_000 + k, f"{words} {path} {rule} {words} {planted if plant else ''} {words}"))
        want.append(planted)
    return rows, want


def test_model_spans_on_held_out_rows(spark):
    """Keys that no rule finds, in rows that the network was not fitted on: most are found, few paths are."""
    schema = "doc_id long, text string"
    net = secrets.fit_secrets(spark.createDataFrame(secret_texts(300, 1, False)[0], schema))
    rows, want = secret_texts(100, 2, True)
    got = {r["doc_id"]: [f for f in r["found"] if f["kind"] == "model"] for r in secrets.scan_secrets(spark.createDataFrame(rows, schema), net).collect()}
    hits = sum(any(t[f["start"] : f["end"]] == w for f in got[d]) for (d, t), w in zip(rows, want))
    false = sum(t[f["start"] : f["end"]] != w for (d, t), w in zip(rows, want) for f in got[d])
    assert hits >= 80 and false <= 20, (hits, false)


def test_numbers_and_paths_are_no_keys(spark):
    schema = "doc_id long, text string"
    net = secrets.fit_secrets(spark.createDataFrame(secret_texts(300, 1, False)[0], schema))
    r = random.Random(6)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    rows = [(k, f"paid with {digits(16)} for order {digits(20)} on page /usr/share/lib/file-{k} of the-long-title-of-a-page-{k}") for k in range(200)]
    found = [f for x in secrets.scan_secrets(spark.createDataFrame(rows, schema), net).collect() for f in x["found"]]
    assert len(found) <= 20, len(found)
