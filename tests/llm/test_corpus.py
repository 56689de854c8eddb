"""The corpus operators against brute force on a small table of odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeveil.llm import components, decontaminate, language, mixing, quality, secrets, sharding, simhash, sketch, substrings, suffixes, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, starts int"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(70))
    texts = [None, "", " \n\t ", "one", "- 12 !", passage, passage, passage + " tail", "head " + passage, "é" * 300, "ab" * 500, "x\x00y " * 60, "A B C D", "a b c d"]
    for k in range(30):
        own = [word() for _ in range(r.randint(1, 260))]
        if k % 3 == 0:
            own[r.randrange(len(own)) : 0] = passage.split()
        if k % 5 == 0:
            own += own[:60]
        texts.append((" " if k % 4 else "\n").join(own))
    long = " ".join(word() for _ in range(30_000))
    texts += [long, long + " more", "### " * 40, "token = '0123456789abcdef0123456789abcdef01234567' AKIA" + "Q7" * 10]
    rows = [(k, t, ("en", "fr")[k % 2], "src0", 0, "clash", k) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[7], (None, passage, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered():
    return sorted(((10**9 if d is None else d, t or "") for d, t, *_ in corpus()), key=lambda x: x[0])


def test_substring_dedup(docs, empty):
    want, seen = [], {}
    rows = ordered()
    for d, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            seen[key] = min(seen.get(key, d), d)
    for d, t in rows:
        w, gone = WORD.findall(t), set()
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [(10**9 if r[0] is None else r[0], *r[1:]) for r in substrings.drop_repeats(docs, bits=16).drop("kept").collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in want) > 500
    assert substrings.drop_repeats(empty, bits=16).count() == 0


@pytest.mark.parametrize("length,most", [(100, 2000), (100, 1), (10, 2000)])
def test_suffix_dedup(docs, empty, length, most, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST", most)
    want, least, rows = [], {}, ordered()
    for d, t in rows:
        b = t.encode()
        for k in range(len(b) - length + 1):
            least[b[k : k + length]] = min(least.get(b[k : k + length], d), d)
    for d, t in rows:
        b, own = t.encode(), set()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if least[s] < d or s in own:
                gone[k : k + length] = b"\1" * length
            own.add(s)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [(10**9 if r[0] is None else r[0], *r[1:]) for r in suffixes.drop_repeats(docs, length=length, bits=20).drop("kept").collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.drop_repeats(empty, bits=16).count() == 0


def test_sketch_loses_no_repeated_key(spark):
    keys = np.array([k * 2654435761 % (1 << 63) for k in list(range(3000)) + list(range(0, 3000, 3))], np.int64)
    frame = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    bits = sketch.repeated_bits(frame, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 16)
    repeated = keys[3000:].view(np.uint64)
    assert sketch.at_least_two(bits, repeated, 16).all()
    assert sketch.at_least_two(bits, keys.view(np.uint64)[:3000], 16).sum() < 1300


def prints():
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for d, t in ordered():
        w = WORD.findall(t.encode().translate(low).decode())
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_simhash(spark, docs, empty, most):
    found = prints()
    extra = random.Random(3)
    base = extra.getrandbits(64)
    near = [(1000 + k, base ^ sum(1 << b for b in extra.sample(range(64), extra.randint(0, 3)))) for k in range(60)]

    def grouped(rows):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return sorted((d, f"{f:016x}", rows[find(i)][0]) for i, (d, f) in enumerate(rows))

    got = [(10**9 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, most=most).collect()]
    assert sorted(got) == grouped(found)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in near], "fp long")
    labels = {r["node"]: r["label"] for r in components.connected(simhash.links(frame, most)).collect()}
    signed = {d: f - (1 << 64) if f >> 63 else f for d, f in near}
    mine = collections.defaultdict(set)
    for d, _, c in grouped(near):
        mine[c].add(signed[d])
    theirs = collections.defaultdict(set)
    for f in set(signed.values()):
        theirs[labels.get(f, f)].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_firsts(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in grouped(found)})


def test_quality_counts(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    for d, t in ordered():
        r, w = got[None if d == 10**9 else d], WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and 0 <= r["quality"] <= 1
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0


def test_language(docs, empty):
    train = docs.sparkSession.createDataFrame([(k, ("the of and that with from this" if k % 2 else "que los para una con del las") + " " + "xyz" * (k % 3), ("en", "es")[k % 2 == 0]) for k in range(40)], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(train)
    said = {r["doc_id"]: r for r in language.identify(docs, profiles).collect()}
    assert said[0]["lang_pred"] == said[1]["lang_pred"] == said[4]["lang_pred"] == "und" and said[3]["lang_pred"] in ("en", "es")
    right = language.identify(train, profiles).join(train, "doc_id").where("lang_pred = lang").count()
    assert right == 40
    assert language.identify(empty, profiles).count() == 0 and language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert {r["doc_id"] for r in language.keep_identified(docs, profiles).select("doc_id").collect()}.isdisjoint({0, 1, 2, 4})
    ids = docs.select("doc_id", language.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in ids)


def test_secrets(docs, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    extra = docs.sparkSession.createDataFrame([(100, "é PASSWORD: hunter22x; secret=abc token: token=abcdef é"), (101, "api_key"), (102, ' = "zzzzzzz" ' + "f" * 24 + "AKIAAKIA" + "A" * 20)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).coalesce(1)
    net = secrets.fit_secrets(both)
    got = {r["doc_id"]: [(f["start"], f["kind"], f["end"]) for f in r["found"]] for r in secrets.scan_secrets(both, net).collect()}
    for d, t in [*ordered(), *((r["doc_id"], r["text"]) for r in extra.collect())]:
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [f for f in got[None if d == 10**9 else d] if f[1] != "model"] == sorted(want, key=lambda f: (f[0], secrets.KINDS.index(f[1])))
    assert secrets.scan_secrets(empty, secrets.fit_secrets(empty)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, empty, name):
    path = public_tokenizers.path(name)
    odd = ["a  b", " x <|endoftext|> y", "a\n b\n\nc", "it's we'll 's", "ß12 é,é", "<|endoftext|>a.b|c", "日本 语", "áb"]
    both = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(enumerate(odd, 200)), "doc_id long, text string"))
    rows = both.collect()
    if name.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation(), t.no_padding()
        want = [len(e.ids) for e in t.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([r["text"] or "" for r in rows])]
    got = token_counts.token_counts(both, path).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, want))
    assert token_counts.token_counts(empty, path).count() == 0


def test_sharding(docs, empty):
    for slices in (100_000, 1):
        rows = sharding.shuffle_shards(docs, 7, slice_rows=slices).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by[k]) for k in range(7)]
        assert max(sizes) - min(sizes) <= 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert sharding.shuffle_shards(empty, 7).count() == 0


def test_communication_matrix_is_exact_and_hypergeometric():
    first = []
    for seed in range(400):
        m = sharding.communication_matrix([30, 0, 70, 5], 4, seed)
        assert m.sum(axis=1).tolist() == [30, 0, 70, 5] and sorted(m.sum(axis=0)) == [26, 26, 26, 27]
        first.append(m[0, 1])
    assert abs(np.mean(first) - 30 * 26 / 105) < 0.4 and abs(np.var(first) - 30 * (26 / 105) * (79 / 105) * 75 / 104) < 0.8
    rng = np.random.default_rng(1)
    big = [sharding._draw(rng, 10**10, 3 * 10**10, 1000) for _ in range(3000)]
    assert abs(np.mean(big) - 250) < 2 and abs(np.var(big) - 187.5) < 20


def test_mixing(spark, empty):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(("aa", "bb") if k % 4 else ("cc", "dd")) for _ in range(30)), "x") for k in range(200)] + [(500, None, "y"), (501, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    labels = spark.createDataFrame([(k, "plain" if k % 4 else "rare") for k in range(80)] + [(None, "rare"), (5, None)], "doc_id long, domain string")
    rates = mixing.mix(docs, labels, {"plain": 0.5, "rare": 0.5}).collect()
    assert len(rates) == 200 and all(x["rate"] >= 0 and abs(sum(x["posterior"].values()) - 1) < 1e-6 for x in rates)
    total = sum(x["tokens"] for x in rates)
    assert abs(sum(x["tokens"] * x["rate"] * x["posterior"]["rare"] for x in rates) / total - 0.5) < 5e-3
    frame = spark.createDataFrame([(x["doc_id"], x["rate"]) for x in rates] + [(None, 3.0)], "doc_id long, rate double")
    out = mixing.apply_rates(docs.unionByName(spark.createDataFrame([(None, "n", "n")], docs.schema)), frame)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 3 and out.where("doc_id >= 500").count() == 2
    assert mixing.mix(empty, labels, {"plain": 1.0}).count() == 0
    assert mixing.mix(docs, labels.where("false"), {"plain": 1.0}).where("rate <> 1").count() == 0
    assert mixing.mix(docs, labels.where("domain = 'plain'"), {"plain": 1.0}).where("abs(rate - 1) > 1e-3").count() == 0


def test_mixing_needs_only_the_words_that_tell(spark):
    """A few telling words among many that don't, in texts whose domains are held out from the labels."""
    r = random.Random(2)
    rows = [(k, " ".join(["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(80)] + (["scorn"] * 2 if k % 5 == 0 else []) + (["odd$$$"] if k % 5 == 1 else []))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, {0: "bad", 1: "odd"}.get(k % 5, "good")) for k in range(300)], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labels)
    got = {x["doc_id"]: dict(zip(model.domains, x["posterior"])) for x in mixing.posteriors(docs, model, ["doc_id"]).where("doc_id >= 300").collect()}
    assert all(max(p, key=p.get) == {0: "bad", 1: "odd"}.get(k % 5, "good") for k, p in got.items())
    assert all(p["good"] > 0.6 for k, p in got.items() if k % 5 > 1)  # that no telling word is there tells something too: above the prior
    rates = {x["doc_id"]: x["rate"] for x in mixing.mix(docs, labels, {"good": 0.8, "odd": 0.15, "bad": 0.05}).collect()}
    assert all(v >= 1 for k, v in rates.items() if k % 5 > 1) and all(v < 0.6 for k, v in rates.items() if k % 5 == 0)


def test_mixing_makes_no_row_for_a_telling_word(spark):
    """The rows that scoring makes don't grow with how often telling words stand in the texts."""
    model = mixing.DomainModel(["a", "b"], [-0.7, -0.7], list(range(1, 1 << mixing.BITS, 33)), [[0.5] * 1986, [-0.25] * 1986], [0.0, 0.0])
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(500))) for k in range(3)] + [(1, "again"), (7, None)], "doc_id long, text string")
    got = mixing.posteriors(docs, model, ["doc_id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    hashes = spark.range(500).select(F.pmod(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string"))), F.lit(1 << mixing.BITS)).alias("b"))
    told = hashes.where((F.col("b") > 0) & (F.pmod(F.col("b") - 1, F.lit(33)) == 0)).distinct().count()
    rows = {r["doc_id"]: (r["tokens"], r["posterior"][0]) for r in got.collect()}
    assert set(rows) == {0, 1, 2} and rows[1][0] == 501 and told > 5
    assert abs(rows[0][1] - 1 / (1 + np.exp(-0.75 * told))) < 1e-9


def edit_distance(item, passage):
    row = [0] * (len(passage) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(passage, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_decontamination(spark, docs, empty):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(r.randint(10, 60)))) for k in range(20)] + [(90, None), (91, "too short")]
    texts = []
    for k in range(120):
        w = items[k % 20][1].split()
        for _ in range(r.randint(0, len(w) // 3)):
            at, how = r.randrange(len(w)), r.randrange(3)
            w[at : at + (how != 0)] = [] if how == 1 else [word()]
        texts.append((300 + k, " ".join([*(word() for _ in range(r.randint(0, 40))), *w, *(word() for _ in range(r.randint(0, 40)))]).title()))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.find_items(frame, bench).collect()}
    want = {}
    for d, t in texts:
        for i, s in items[:20]:
            n = edit_distance(s.split(), t.lower().split())
            if n <= len(s.split()) // 5:
                want[d, i] = n
    assert len(want) > 40 and got.keys() <= want.keys() and len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got)
    clean = decontaminate.drop_contaminated(frame, bench)
    assert {r["doc_id"] for r in frame.collect()} - {r["doc_id"] for r in clean.collect()} == {d for d, _ in got}
    split = decontaminate.find_items(frame, bench, block=7).collect()
    assert {(x["doc_id"], x["item_id"]) for x in split} == set(got)
    assert decontaminate.find_items(empty, bench).count() == 0 and decontaminate.find_items(frame, bench.where("false")).count() == 0
    r.seed(2)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 90))] for _ in range(2))
        assert decontaminate.passage_distance(a, b) == edit_distance(a, b)
