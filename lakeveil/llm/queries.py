"""The registered queries op1 to op13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import conversations, decontaminate, infill, language, minmax, mixing, quality, secrets, sharding, simhash, substrings, suffixes, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the mixture by domain of the labels: fit text, unfit text, toxic text. More than the corpus has of the
#: first, for what a model should learn, and a trace of the others, which it must know to tell.
TARGETS = {"good": 0.86, "junk": 0.08, "toxic": 0.06}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain from quality and toxic marks; a row without a quality mark has no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", domain.alias("domain"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rates = mixing.mix(docs, label_domains(labels), TARGETS)
    shares = [F.element_at("posterior", F.lit(n)).alias(f"p_{n}") for n in TARGETS]
    return rates.select("doc_id", "tokens", *shares, "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"), "reached", "on_target")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = sharding.shuffle_shards(rows, 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.where(~language.held_out()))
    return language.identify(docs, profiles).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.fit_secrets(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "model")
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and repeated rows: see ``conversations.damage`` and ``conversations.repair``."""
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and repeated rows: see ``minmax.near_duplicates``."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and repeated rows: see ``infill.fill_in_middle``."""
    told = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of operator 4, which SQL can tell."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of operator 5: rows, slots and bytes by shard do not depend on the draw but for the bytes."""
    dealt = op5_shard_documents(spark, sf_dir)
    return dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule spans of operator 7, counted by kind."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict:
    own = (op1_decontaminate, op2_mix_sources, op3_simhash_dedup, op4_quality_rules, op5_shard_documents, op6_language_id, op7_secret_scan, op8_suffix_dedup, op9_token_counts, op10_substring_dedup, op11_repair_conversations, op12_minhash_dedup, op13_fill_in_middle)
    return {f.__name__: f for f in (*own, quality_base_counts, shard_law, secret_base_counts)}


#: The words of every document, and whether each word lies in a window of {n} words for which {hit} holds.
_WORDS = r"w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w, coalesce(text, '') as t from documents)"
_WINDOWS = "p as (select doc_id, w, unnest(range(1, len(w) - {n} + 2)) as i from w where len(w) >= {n}), k as (select doc_id, i, md5(array_to_string(w[i : i + {n} - 1], ' ')) as key from p)"
_COVERED = "u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w), c as (select u.doc_id, u.i, u.x, coalesce(sum(h.one) over (partition by u.doc_id order by u.i rows between {n} - 1 preceding and current row), 0) > 0 as gone from u left join h on u.doc_id = h.doc_id and u.i = h.i)"


_INFILL = r"""with t as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
    u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k::int + 1, 8))::ubigint::bigint) as d from t),
    c as (select *, len(u)::bigint as n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as lo, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as hi,
      case when t = '' or regexp_matches(t, '<[PSM]>') then 'plain' when d[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
    p as (select *, array_to_string(u[1 : lo], '') as x, array_to_string(u[lo + 1 : hi], '') as m, array_to_string(u[hi + 1 :], '') as s from c)
    select doc_id, n, form, case when form <> 'plain' then length(x) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
      sha256(case form when 'psm' then '<P>' || x || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || x || '<M>' || m else t end) as output_sha256, sha256(t) as restored_sha256 from p"""

#: All links between different sets by common shingles, and the least document that they reach.
_NEAR = r"""with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
    s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end)) as s from t),
    k as (select md5(array_to_string(s, chr(10))) as k, min(doc_id) as d, any_value(s) as s, len(any_value(s)) as n from s where len(s) > 0 group by 1),
    x as (select d, n, unnest(s) as x from k),
    e as (select a.d as a, b.d as b from x a join x b on a.x = b.x and a.d < b.d and 20 * least(a.n, b.n) >= 17 * greatest(a.n, b.n) group by a.d, b.d, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    g as (select a, b from e union all select b, a from e), r(a, b) as (select d, d from k union select r.a, g.b from r join g on r.b = g.a), c as (select a as d, min(b) as c from r group by a)
    select doc_id, len(s.s)::bigint as n_shingles, coalesce(c.c, doc_id) as component_id, doc_id = coalesce(c.c, doc_id) as kept from s left join k on md5(array_to_string(s.s, chr(10))) = k.k and len(s.s) > 0 left join c on c.d = k.d"""

#: CRC-32 by its table; a row's faults, the ways from state to state by code, and the cheapest, least audits by state, row by row. What follows an audit is
#: told by its end state; the texts of the repaired rows are told by walking through the audit.
_REPAIR = r"""with recursive c as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)::bigint[]), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab),
    b as (select *, list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)) as key from conversations),
    o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(key, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 20 as kind from b, c),
    x as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as again from o where kind <> 0),
    n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as p, row_number() over (partition by conv_id, role, text order by turn nulls first, again) as nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from x),
    f as (select *, case when bare = '' then 'blank' when nth > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by p) as before from n),
    q(a, i, b) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), v(a, b) as (values (0, 2), (1, 2), (2, 3), (3, 2)),
    z(a, b, c, l) as (select a, a, 0, '' from v union all select a, b, 3, 'I' from v union all select v.a, w.b, 6, 'II' from v join v w on v.b = w.a),
    w as (select z.a, q.i, null as cut, q.b, z.c, z.l || 'K' as l, false as gone from z join q on z.b = q.a union all select z.a, null, null, v.b, z.c + 3, z.l || 'R', false from z join v on z.b = v.a union all select z.a, null, null, z.b, z.c + 4, z.l || 'D', true from z),
    s(conv_id, p, st, best) as (select distinct conv_id, 0::bigint, 0, {'c': 0, 'l': ''} from f
      union all select s.conv_id, f.p, w.b, min({'c': (s.best).c + w.c + case when f.fault = 'truncated' and not w.gone then 3 else 0 end, 'l': (s.best).l || w.l})
      from s join f on s.conv_id is not distinct from f.conv_id and f.p = s.p + 1 join w on w.a = s.st and (w.i is null or w.i = f.i) and (w.gone or f.fault is null or f.fault = 'truncated') group by s.conv_id, f.p, w.b),
    m as (select conv_id, max(p) as p from s group by conv_id),
    y as (select s.conv_id, min({'c': (s.best).c + [0, 6, 3, 0][s.st + 1], 'l': (s.best).l || ['', 'II', 'I', ''][s.st + 1]}) as best from s join m on s.conv_id is not distinct from m.conv_id and s.p = m.p group by s.conv_id),
    d(conv_id, k, row, st, told) as (select conv_id, 0, 0::bigint, 0, '' from y
      union all select d.conv_id, d.k + 1, d.row + (e.l <> 'I')::bigint, case when e.l in ('I', 'R') then v.b when e.l = 'K' then q.b else d.st end,
        d.told || case when e.l = 'D' then '' else case when d.told = '' then '' else chr(10) end || case when e.l = 'K' then f.role else ['user', 'user', 'assistant', 'user'][d.st + 1] end || ':' || case when e.l = 'I' then '' else f.text end end
      from d join (select conv_id, (best).l as a from y) y on y.conv_id is not distinct from d.conv_id and d.k < length(y.a) cross join lateral (select substr(y.a, d.k + 1, 1) as l) e
      join v on v.a = d.st left join f on f.conv_id is not distinct from d.conv_id and f.p = d.row + 1 left join q on q.a = d.st and q.i = f.i),
    t as (select d.conv_id, d.told from d join y on y.conv_id is not distinct from d.conv_id where d.k = length((y.best).l)),
    g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || i not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
    a as (select distinct conv_id from conversations)
    select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce((y.best).c, 0)::bigint as cost, coalesce((y.best).l, '') as audit, sha256(coalesce(t.told, '')) as repaired_sha256
    from a left join g on g.conv_id is not distinct from a.conv_id left join y on y.conv_id is not distinct from a.conv_id left join t on t.conv_id is not distinct from a.conv_id"""


def oracle_sql() -> dict[str, str]:
    windows = lambda n: _WINDOWS.replace("{n}", str(n))
    covered = lambda n: _COVERED.replace("{n}", str(n))
    return {
        "op11_repair_conversations": _REPAIR,
        "op12_minhash_dedup": _NEAR,
        "op13_fill_in_middle": _INFILL,
        "op10_substring_dedup": f"""with {_WORDS}, {windows(50)}, f as (select key, min(doc_id) as first from k group by key), h as (select doc_id, i, 1 as one from k join f using (key) where doc_id > first), {covered(50)},
            g as (select doc_id, count(*) filter (gone) as n_removed, array_to_string(list(x order by i) filter (not gone), ' ') as kept from c group by doc_id)
            select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join g using (doc_id)""",
        "quality_base_counts": f"""with {_WORDS}, {windows(8)}, f as (select doc_id, key from k group by all having count(*) > 1), h as (select doc_id, i, 1 as one from k semi join f using (doc_id, key)), {covered(8)},
            r as (select doc_id, count(*) filter (gone) as n from c group by doc_id),
            l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by doc_id),
            b as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join l using (doc_id) left join r using (doc_id))
            select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b""",
        "shard_law": "with n as (select count(*) as n from documents), s as (select unnest(range(40)) as shard, n from n), r as (select shard, n // 40 + (shard < n % 40)::int as rows from s) select shard::int as shard, rows::bigint as rows, 0::bigint as first_slot, (rows - 1)::bigint as last_slot, rows::bigint as slots from r where rows > 0",
        "secret_base_counts": r"""select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::bigint as n_assign,
            len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex from documents""",
    }
