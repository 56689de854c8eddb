"""Conversation repair, min-max dedup and fill-in-middle against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from lakeveil.llm import conversations, infill, minmax

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """All edit sequences of rows (initial, fault), told breadth-first by state with whole audits: cost and audit."""
    best = {0: (0, "")}

    def inserted(found):
        for _ in range(3):
            for q, (cost, audit) in list(found.items()):
                for letter in "ua":
                    if (to := STEPS.get((q, letter))) is not None:
                        found[to] = min(found.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return found

    for initial, fault in rows:
        found = {}
        for q, (cost, audit) in inserted(dict(best)).items():
            cut = 3 * (fault == "truncated")
            ways = [(q, cost + 4, audit + "D")]
            if fault not in ("blank", "duplicate"):
                if (to := STEPS.get((q, initial))) is not None:
                    ways.append((to, cost + cut, audit + "K"))
                ways += [(to, cost + cut + 3, audit + "R") for letter in "ua" if (to := STEPS.get((q, letter))) is not None]
            for to, *way in ways:
                found[to] = min(found.get(to, (10**9, "")), tuple(way))
        best = found
    return min(v for q, v in inserted(dict(best)).items() if q in (0, 3))


def test_every_short_conversation_is_repaired_by_the_cheapest_least_audit():
    kinds = [("s", None), ("u", None), ("a", None), ("t", None), ("s", "truncated"), ("u", "truncated"), ("a", "truncated"), ("u", "blank")]
    r = random.Random(3)
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)] + [[r.choice(kinds) for _ in range(r.randint(4, 40))] for _ in range(400)]
    for rows in cases:
        codes = bytes(conversations.row_code(i, f) for i, f in rows)
        told = conversations.audits(codes)
        at = 0
        for letters, (initial, _) in zip(told, rows):
            for x in letters:
                at = conversations.AFTER[at] if x in "IR" else STEPS[at, initial] if x == "K" else at
        audit = "".join(told) + conversations.TAIL[at]
        cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in audit) + sum(3 for letters, (_, f) in zip(told, rows) if f == "truncated" and letters[-1] != "D")
        assert (cost, audit) == cheapest(rows), rows


def test_pieces_cross_where_the_whole_does():
    r = random.Random(5)
    for _ in range(200):
        codes = bytes(r.randrange(9) for _ in range(r.randint(1, 60)))
        extra = [r.choice([0, 0, 0, 2]) for _ in codes]
        cuts = sorted({0, len(codes), *(r.randrange(len(codes)) for _ in range(3))})
        parts = [(codes[a:b], extra[a:b]) for a, b in zip(cuts, cuts[1:])]
        states = conversations.crossings([conversations.piece_costs(*p) for p in parts])
        told = [x for p, (entry, leave) in zip(parts, states) for x in conversations._audits(*p, entry, [0 if q == leave else conversations.INF for q in range(4)])]
        assert told == conversations._audits(codes, extra)


def plain_report(rows):
    """Of rows (conv_id, turn, role, text): what the contract says, conversation by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = cheapest([(x[1][:1], f) for x, f in zip(own, faults)])
        at, k, lines = 0, 0, []
        for x in audit:
            name = "assistant" if at == 2 else "user"
            if x == "I":
                lines.append(f"{name}:")
            elif x != "D":
                lines.append(f"{own[k][1] if x == 'K' else name}:{own[k][2]}")
            k += x != "I"
            at = STEPS[at, own[k - 1][1][:1] if x == "K" else name[0]] if x != "D" else at
        turns = {t for t, _, _ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed, convs=25, most=30):
    r = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for k in range(r.randint(1, most)):
            turn = r.choice([k, k, k, k, k + 3, None, 2])
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "no", "", " \n", "What?", f"No {k}!", f"und {k}", "Привет.", None, "x" * 500 + "."])))
    return rows + rows[:20]


@pytest.mark.parametrize("rows_held", [20_000, 3])
def test_repair_of_damaged_conversations(spark, monkeypatch, rows_held):
    """Null ids, turns, roles and texts, ties, repeats; long conversations cut into pieces give the same as whole ones."""
    monkeypatch.setattr(conversations, "ROWS", rows_held)
    rows = talk(1)
    frame = spark.createDataFrame([(*x, 7, "b") for x in rows], "conv_id long, turn long, role string, text string, cost long, edit string").repartition(5)
    got = {x["conv_id"]: tuple(x)[1:] for x in conversations.report(conversations.damage(frame)).collect()}
    assert got == plain_report(rows)


def test_a_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", 100)
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], f"text {k % 40}.") for k in range(3000)] + [(2 + k // 5, k % 5, "user", "x") for k in range(4000)]
    got = {x["conv_id"]: tuple(x)[1:] for x in conversations.report(conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == plain_report(rows)


def test_no_conversations_and_all_rows_gone(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.report(conversations.damage(spark.createDataFrame([], schema))).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = conversations.report(conversations.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def sets_of(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def test_min_max_links_are_those_of_brute_force(spark):
    """Groups of copies with changed words, on both sides of 0.85, copies, texts of few or no words, null ids and repeated rows."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "One two", "one\ttwo", "x", "É y", "é y"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(40, 220))]
        for _ in range(14):
            own = list(base)
            for _ in range(r.randint(0, 7)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own).title())
    rows = list(enumerate(texts)) + [(5, "x"), (None, "x"), (None, "alone here"), (None, None)]
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), 10**9 if d is None else d)
    told = [(d, len(s), None if least[find(i)] == 10**9 else least[find(i)], (10**9 if d is None else d) == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    docs = spark.createDataFrame([(*x, 1, "r") for x in rows], "doc_id long, text string, n long, root string").repartition(3)
    got = [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minmax.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(told, key=repr)
    assert 12 < len({t[2] for t in told}) < 150
    assert minmax.near_duplicates(docs.where("false")).count() == 0


def test_min_max_estimates_are_unbiased_from_half_the_hashes():
    r = np.random.default_rng(1)
    both, one, two = (r.integers(0, 1 << 64, n, np.uint64) for n in (800, 100, 100))
    near = []
    for k in range(60):
        salt = r.integers(0, 1 << 64, 1, np.uint64)
        x, y = np.concatenate([both, one]) ^ salt, np.concatenate([both, two]) ^ salt
        a, b = minmax.min_max(np.concatenate([x, y]), np.array([0, 900, 1800]))
        near.append((a == b).mean())
    assert abs(np.mean(near) - 0.8) < 0.02 and minmax.PERMUTATIONS * 2 == a.size
    assert np.var(near) < 1.3 * 0.8 * 0.2 / a.size


def test_line_ends_are_predicted_and_corrected_exactly():
    r = random.Random(2)
    texts = ["", "\n", "a", "a\n", "\n\n\nb", "é\nü", "".join("x" * r.choice([0, 1, 3, 900]) + r.choice(["\n", "", "y\n"]) for _ in range(3000))]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    ends, base = infill.line_ends(data, offsets)
    for error in (1, 20, 120):
        index = infill.fit_index(ends, base, error)
        assert np.abs(index.residuals.astype(int)).max() <= error
        for k, t in enumerate(texts):
            want = [0, *itertools.accumulate(len(x.encode()) for x in t.split("\n")[:-1] and [y + "\n" for y in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else []) or ([t] if t else []))]
            n = int(base[k + 1] - base[k])
            assert index.cut(np.full(n, k), np.arange(n)).tolist() == want
    assert len(infill.fit_index(ends, base, 120).starts) < len(infill.fit_index(ends, base, 1).starts) < len(ends)


def test_fill_in_middle(spark):
    texts = {1: "a\nb\nc", 2: "", 3: None, 4: "x <S> y\n", 5: "\n" * 50, 6: "über\nα\nβ\n" * 200, 7: "one line", 8: "z" * 300_000 + "\nend", None: "q\nr\n"}
    rows = [(d, t, 3, "n") for d, t in texts.items()] + [(1, "a\nb\nc", 3, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(2)
    told = infill.fill_in_middle(docs).withColumn("back", infill.restored(infill.F.col("output"), infill.F.col("form"))).collect()
    assert len(told) == 10
    forms = set()
    for x in told:
        t = texts[x["doc_id"]] or ""
        units = [u + "\n" for u in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
        digest = hashlib.sha256(f"7:{'' if x['doc_id'] is None else x['doc_id']}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        first, mid, rest = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
        form = "plain" if not t or "<S>" in t else "spm" if h[3] % 100 < 50 else "psm"
        want = {"plain": t, "psm": f"<P>{first}<S>{rest}<M>{mid}", "spm": f"<S>{rest}<P>{first}<M>{mid}"}[form]
        lengths = (None, None) if form == "plain" else (len(first), len(mid))
        assert (x["n"], x["form"], x["output"], x["back"], x["prefix_chars"], x["middle_chars"]) == (len(units), form, want, t, *lengths)
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(docs.where("false")).count() == 0
    assert all(x["form"] == "plain" for x in infill.fill_in_middle(docs, rate=0).collect())
