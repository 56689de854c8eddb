"""The registered queries: their SQL, and the contract's columns against plain versions."""

import hashlib
import re
import zlib

import oracle
import pytest

from lakeveil.llm import queries

SQL = queries.oracle_sql()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, oracle.scale(), "documents").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert oracle.compare(spark, oracle.scale(), queries.queries()[name], SQL[name]) == ""


def test_op5_columns(spark, texts):
    rows = queries.op5_shard_documents(spark, oracle.scale()).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert all(r["law"] == "rows" and 0 <= r["shard"] < 40 and r["grown_shard"] is None for r in rows)


def test_op6_columns(spark, texts):
    rows = queries.op6_language_id(spark, oracle.scale()).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in texts}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]])) for r in rows)


def test_op7_columns(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.op7_secret_scan(spark, oracle.scale()).collect():
        t = texts[r["doc_id"]]
        want = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [w[2] for w in sorted(want)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("model")] == base


def test_op8_columns(spark, texts):
    seen, want = {}, {}
    for d, t in sorted(texts.items()):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            key = raw[k : k + 100]
            if key in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen[key] = d
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[d] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op8_suffix_dedup(spark, oracle.scale()).collect()} == want


def test_op2_columns(spark, texts):
    rows = queries.op2_mix_sources(spark, oracle.scale()).collect()
    assert {r["doc_id"]: r["tokens"] for r in rows} == {d: n for d, t in texts.items() if (n := len(WORD.findall(t)))}
    assert all(r["rate"] >= 0 and int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in rows)
