"""Registered queries of the privacy operators and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, references
from ..operators import audit, pages, patterns, textstats, vault
from ..sources.readers import conversation_units, document_units, payload, spread, table
from .holdout import BLOCKS, block, inject, sql_inject

LEAST = 0.8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject(document_units(spread(table(spark, sf_dir, "documents"))))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject(conversation_units(spread(table(spark, sf_dir, "conversations"))))


def detected(units: DataFrame) -> DataFrame:
    return vault.occurrences(patterns.with_detections(units, least=LEAST))


def sanitize(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sanitized units, the vault and the occurrences of a table of units."""
    found = detected(units)
    minted = vault.mint(found)
    return vault.apply_tokens(units, found, minted), minted, found


def r6_sanitized_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: conversation turns with values replaced by session-stable tokens."""
    return sanitize(_turns(spark, sf_dir))[0].select("session_id", "unit_seq", "text")


def count_candidates(units: DataFrame) -> DataFrame:
    """Matches of every rule by kind, before overlaps are resolved away."""
    folded = units.select("session_id", F.explode(patterns.regions(patterns.scannable(F.col("text")))).alias("text")).where(F.col("text").rlike(patterns.PROMISING))
    parts = []
    for rule in patterns.RULES:
        raw = F.when(F.col("text").rlike(rule.guard), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))
        parts.append(F.struct(F.lit(rule.kind).alias("kind"), raw.alias("raws")))
    rows = folded.select("session_id", F.explode(F.array(*parts)).alias("r")).select("session_id", "r.kind", F.explode("r.raws").alias("raw"))
    ok = checksums.verify(F.col("kind"), F.col("raw"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(ok).alias("verified"), F.count_distinct("session_id").alias("documents"))


def d2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all eight kinds, and how many of them their check verifies."""
    return count_candidates(_documents(spark, sf_dir))


def d2_all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rule and by how many candidates a document has: one, two to nine, or more."""
    units = _documents(spark, sf_dir)
    folded = units.select("session_id", F.explode(patterns.regions(patterns.scannable(F.col("text")))).alias("text")).where(F.col("text").rlike(patterns.PROMISING))
    sizes = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.size(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("n")) for r in patterns.RULES))
    counts = folded.select("session_id", F.inline(sizes)).groupBy("session_id", "kind").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.groupBy("kind", F.when(F.col("n") == 1, "one").when(F.col("n") < 10, "two to nine").otherwise("more").alias("candidates")).agg(F.count(F.lit(1)).alias("documents"))


def d12_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.with_detections(_documents(spark, sf_dir))
    return found.select("session_id", F.explode_outer("detections").alias("d")).where("d is not null").select("session_id", "d.kind", "d.start", "d.end", "d.raw", "d.verified", "d.confidence")


def d4_aadhaar_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 over numbers derived from order keys: how many pass the check digit, by first digit."""
    digits = F.lpad(((F.col("o_orderkey") * 7919 + 234567) * 104729 % 1000000000000).cast("string"), 12, "2")
    rows = table(spark, sf_dir, "orders").select(digits.alias("d"))
    return rows.groupBy(F.substring("d", 1, 1).alias("first_digit")).agg(F.count(F.lit(1)).alias("numbers"), F.count_if(checksums.is_aadhaar(F.col("d"))).alias("valid"))


def d5_card_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(((F.col("o_orderkey") * 104729 + 17) * 1299709 % 10000000000000000).cast("string"), 16, "4")
    rows = table(spark, sf_dir, "orders").select(digits.alias("d"))
    return rows.groupBy(F.substring("d", 1, 1).alias("first_digit")).agg(F.count(F.lit(1)).alias("numbers"), F.count_if(checksums.is_card(F.col("d"))).alias("valid"))


def r5_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts by session and kind; the values themselves stay in the vault."""
    return sanitize(_turns(spark, sf_dir))[1].groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("tokens"), F.max("n").cast("long").alias("last_n"))


def r10_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.withheld_counts(detected(_turns(spark, sf_dir)))


def r12_rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, minted, _ = sanitize(_turns(spark, sf_dir))
    return vault.rehydrate(clean, minted).select("session_id", "unit_seq", "text")


def k1_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload(sanitize(_turns(spark, sf_dir))[0])


def l1_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked previews of the injected values, by kind."""
    found = detected(_turns(spark, sf_dir))
    shown = found.select("kind", audit.masked(F.col("kind"), F.col("value")).alias("preview"))
    return shown.groupBy("kind", "preview").agg(F.count(F.lit(1)).alias("times"))


def l3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(vault.withheld_counts(detected(_turns(spark, sf_dir))))


def v1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vault values left in their session's sanitized text, and a control: the same over the raw text."""
    units = _turns(spark, sf_dir)
    clean, minted, _ = sanitize(units)
    count = lambda wire, name: audit.leaks(minted, wire).agg(F.count(F.lit(1)).alias("leaks")).select(F.lit(name).alias("channel"), "leaks")
    return count(clean, "sanitized").unionByName(count(units, "raw"))


def v7_invented(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, minted, _ = sanitize(_turns(spark, sf_dir))
    quoted = clean.withColumn("text", F.concat("text", F.lit(" <PII_PAN_77>")))
    return audit.invented_tokens(quoted, minted)


def _scored(units: DataFrame) -> DataFrame:
    """Units with an injected line: its kind, and the confident detections of the whole text, those that touch the
    injected value (``own``) and the others (``others``); ``hit`` if one of its kind covers it."""
    value, kind = block(F.col("session_id"), 1), block(F.col("session_id"), 2)
    found = patterns.with_detections(units, least=LEAST)
    end = F.length("text")
    start = end - F.length(value)
    touches = lambda d: (d["start"] < end) & (d["end"] > start)
    hit = F.exists("detections", lambda d: (d["kind"] == kind) & (d["start"] <= start) & (d["end"] >= end))
    return found.select("session_id", kind.alias("kind"), hit.alias("hit"), F.filter("detections", touches).alias("own"), F.filter("detections", lambda d: ~touches(d)).alias("others"))


def score_injected(units: DataFrame) -> DataFrame:
    any_own = F.size("own") > 0
    return _scored(units).groupBy(F.coalesce("kind", F.lit("DECOY")).alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("hits"), F.count_if(F.col("kind").isNull() & any_own).alias("false_alarms"))


def other_detections(units: DataFrame) -> DataFrame:
    rows = _scored(units).select("session_id", F.explode("others").alias("d"))
    return rows.groupBy("d.kind").agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("session_id").alias("documents"))


def t1_injected_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and false alarms of patterns alone at the injected value, found in the whole text, by kind (decoys:
    DECOY). A decoy with a valid check digit is a false alarm that only its label could tell."""
    return score_injected(_documents(spark, sf_dir))


def t1_other_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident detections of the same scan beside the injected values, by kind: the texts' own, true or not."""
    return other_detections(_documents(spark, sf_dir))


def t10_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = textstats.statistics(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    return s.select("doc_id", "em", "en", "ellipsis", "semis", "words", "distinct_words", "hapax", "sentences", F.round("mean_len", 6).alias("mean_len"), F.round("sd_len", 6).alias("sd_len"), "short", "long", "opener_count", "tells")


def t11_text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = textstats.verdict(textstats.statistics(spread(table(spark, sf_dir, "documents")).select("doc_id", "text")))
    return v.groupBy("burstiness_band", "dash_flag", "opener_flag", "ellipsis_flag", "word_flag").agg(F.count(F.lit(1)).alias("documents"))


def p1_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by kind and tag over all pages."""
    return pages.tokens(table(spark, sf_dir, "pages")).groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("page_id").alias("pages"))


def p1_page_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth reached and left at the end by page; a page that ends at 0 is well formed."""
    found = pages.with_depth(pages.tokens(table(spark, sf_dir, "pages")))
    return found.groupBy("page_id").agg(F.max("depth").alias("most_depth"), F.min("depth").alias("least_depth"), F.max_by("depth", "seq").alias("end_depth"), F.count(F.lit(1)).alias("tokens"))


def p22_page_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(pages.origin(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("pages"))


def p24_capture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with 100 opening tags or more."""
    return pages.capturable(table(spark, sf_dir, "pages"))


def p26_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", pages.is_question(F.col("text")).alias("is_question"))


QUERIES = [
    r6_sanitized_turns, d2_candidates, d2_all_candidates, d4_aadhaar_rate, d5_card_rate, d12_detections, r5_vault, r10_withheld, r12_rehydrated, k1_payloads, l1_previews, l3_totals,
    v1_leaks, v7_invented, t1_injected_score, t1_other_detections, t10_text_statistics, t11_text_verdict, p1_page_tokens, p1_page_depth, p22_page_origin, p24_capture_gate, p26_questions,
]


def queries() -> dict:
    from . import field_queries, log_queries, name_queries, page_queries  # they use this module's sanitize

    return {f.__name__: f for f in [*QUERIES, *field_queries.QUERIES, *page_queries.QUERIES, *log_queries.QUERIES, *name_queries.QUERIES]}


def _verhoeff_sql(d: str) -> str:
    """The check of a 12-digit string as nested table lookups."""
    times, powers = checksums.dihedral_tables()
    out = "0"
    for i in range(12):
        digit = f"coalesce(try_cast(substr({d}, {12 - i}, 1) as int), 0)"
        out = f"[{','.join(map(str, times))}][({out}) * 10 + [{','.join(map(str, powers[10 * (i % 8) : 10 * (i % 8) + 10]))}][{digit} + 1] + 1]"
    return f"({out}) = 0"


def _luhn_sql(d: str, n: int) -> str:
    digit = lambda i: f"coalesce(try_cast(substr({d}, {i}, 1) as int), 0)"
    parts = [digit(i) if (n - i) % 2 == 0 else f"({digit(i)} * 2 - case when {digit(i)} > 4 then 9 else 0 end)" for i in range(1, n + 1)]
    return f"({' + '.join(parts)}) % 10 = 0"


def _gstin_sql(s: str) -> str:
    value = lambda i: f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({s}, {i}, 1)) - 1)"
    total = " + ".join(f"(({value(i)} * {2 - i % 2}) // 36 + ({value(i)} * {2 - i % 2}) % 36)" for i in range(1, 15))
    return f"(36 - ({total}) % 36) % 36 = {value(15)}"


def oracle_sql() -> dict[str, str]:
    docs = f"select doc_id as session_id, {sql_inject('doc_id', 'text')} as text from documents"
    turns = f"select conv_id as session_id, turn as unit_seq, {sql_inject('conv_id', 'text')} as text from conversations"
    n = len(BLOCKS)
    kinds = {
        "PAN": (r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b", "regexp_full_match(upper(raw), '[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]')"),
        "GSTIN": (r"(?i)\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", _gstin_sql("upper(raw)")),
        "IFSC": (r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", "true"),
        "PHONE": (r"(?:\+?91[ -]?)?\b[6-9][0-9]{4}[ -]?[0-9]{5}\b", "regexp_full_match(regexp_replace(regexp_replace(raw, '[ ()-]', '', 'g'), '^(\\+91|91|0)', ''), '[6-9][0-9]{9}')"),
        "AADHAAR": (r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", _verhoeff_sql("regexp_replace(raw, '[ -]', '', 'g')")),
    }
    luhn = "length(regexp_replace(raw, '[ -]', '', 'g')) between 13 and 19 and list_sum(list_transform(list_reverse(string_split(regexp_replace(raw, '[ -]', '', 'g'), '')), lambda x, i: case when i % 2 = 1 then x::int when x::int > 4 then x::int * 2 - 9 else x::int * 2 end)) % 10 = 0"
    kinds |= {
        "CARD": (r"\b(?:[0-9][ -]*?){13,19}\b", luhn),
        "EMAIL": (r"\b[^\s@]+@[^\s@.]+\.[^\s@,;]{2,}\b", r"regexp_full_match(trim(raw), '[^\s@]+@[^\s@.]+\.[^\s@]{2,}')"),
        "UPI": (r"\b[a-zA-Z0-9._-]{2,64}@[a-zA-Z][a-zA-Z0-9]{1,29}\b", "true"),
    }
    d2 = " union all ".join(f"select '{k}' as kind, session_id, raw, {ok} as ok from (select session_id, unnest(regexp_extract_all(text, '{p}')) as raw from d)" for k, (p, ok) in kinds.items())
    questions = " or ".join(["g like '%?'", *(f"starts_with(g, '{q}')" for q in pages.QUESTIONS)])
    tokens = r"(?s)(<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]+>|[^<]+)"
    tagged = f"""t as (select page_id, unnest(l) as raw, generate_subscripts(l, 1) - 1 as seq from (select page_id, regexp_extract_all(html, '{tokens}', 1) as l from pages)),
        k as (select page_id, seq, raw, case when regexp_matches(raw, '(?is)^<(!|\\?|script\\b|style\\b)') then 'skip' when starts_with(raw, '</') then 'close' when regexp_matches(raw, '^<[A-Za-z]') then 'open' else 'text' end as kind,
              lower(regexp_extract(raw, '^</?\\s*([A-Za-z][A-Za-z0-9-]*)', 1)) as tag from t)"""
    # Pages of the given tables have text only where the tag before it opens its element, but for tags without content.
    owned = r"""o as (select *, max(case when kind in ('open', 'close') and tag not in ('br', 'meta', 'link', 'img', 'input', 'hr') then seq end) over (partition by page_id order by seq) as owner from k),
        x as (select page_id, owner, string_agg(raw, '' order by seq) as raw from o where kind = 'text' group by 1, 2),
        e as (select k.page_id, k.tag, coalesce(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x.raw, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), '[\s' || chr(160) || ']+', ' ', 'g')), '') as own from k left join x on k.page_id = x.page_id and k.seq = x.owner where k.kind = 'open')"""
    # The same with all references and blanks that the tree reads: seven replacements in turn leave out others, and a page may be cut within one (&amp at the end of a title).
    decoded = f"""{owned[: owned.index("e as (")]}{references.sql_decoded("y", "x", "page_id, owner", "raw")},
        e as (select k.page_id, k.tag, coalesce(trim(regexp_replace(y.raw, '{references.BLANKS}', ' ', 'g')), '') as own from k left join y on k.page_id = y.page_id and k.seq = y.owner where k.kind = 'open')"""
    flat = ", ".join(f"'{t}'" for t in pages.FLAT)
    tells = "|".join(textstats.TELLS).replace("'", "''")
    prose = r"""p as (select doc_id, regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
              lambda s: length(s) >= 45 and not regexp_matches(s, '^(Figure|Table|Priority|Measure|[0-9])')), ' '), '\s+', ' ', 'g') as p from documents),
        q as (select * from p where p <> ''),
        s0 as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as k from (select doc_id, string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) as l from q)),
        s as (select doc_id, k, list_filter(string_split(trim(s), ' '), lambda w: w <> '') as w from s0 where len(list_filter(string_split(trim(s), ' '), lambda w: w <> '')) > 5),
        l as (select doc_id, count(*) as sentences, avg(len(w)) as mean_len, stddev_pop(len(w)) as sd_len, sum(len(w))::hugeint as sum_len, sum(len(w) * len(w))::hugeint as sum_squares, count(*) filter (len(w) < 12) as short, count(*) filter (len(w) > 32) as long from s group by 1),
        o as (select doc_id, max(n) as opener_count from (select doc_id, lower(array_to_string(w[1:2], ' ')) as o, count(*) as n from s group by 1, 2) group by 1),
        v as (select doc_id, w, count(*) as c from (select doc_id, unnest(regexp_extract_all(lower(p), '[a-z][a-z''-]*')) as w from q) group by 1, 2),
        u as (select doc_id, sum(c)::bigint as words, count(*) as distinct_words, count(*) filter (c = 1) as hapax from v group by 1),
        m as (select doc_id, length(p) - length(replace(p, '—', '')) as em, length(p) - length(replace(p, '–', '')) as en, length(p) - length(replace(p, '…', '')) + (length(p) - length(replace(p, '...', ''))) // 3 as ellipsis, length(p) - length(replace(p, ';', '')) as semis, len(regexp_extract_all(lower(p), '{tells}')) as tells from q),
        r as (select * from m join u using (doc_id) left join l using (doc_id) left join o using (doc_id))""".replace("{tells}", tells)
    values = ", ".join(f"({k}, {'null' if b[2] is None else repr(b[2])}, '{b[1]}')" for k, b in enumerate(BLOCKS))
    hit = f"b(k, kind, value) as (values {values}), u as ({turns}), h as (select u.*, b.kind, b.value from u left join b on session_id % {n} = b.k where kind is not null), f as (select * from h union all select u.*, 'AADHAAR', b.value from u join b on session_id % {n} = b.k where b.kind is null and regexp_full_match(b.value, '[2-9][0-9]{{11}}') and {_verhoeff_sql('b.value')} union all select u.*, 'CARD', b.value from u join b on session_id % {n} = b.k where b.kind is null and regexp_full_match(b.value, '[0-9]{{16}}') and {_luhn_sql('b.value', 16)})"
    shown = "case when length(value) <= 4 then repeat('•', greatest(3, length(value))) else value[1:2] || repeat('•', least(12, length(value) - 3)) || value[-1:] end"
    clean = f"{hit}, s as (select u.session_id, u.unit_seq, case when f.value is null then u.text else replace(u.text, f.value, '<PII_' || f.kind || '_1>') end as text from u left join f on u.session_id = f.session_id and u.unit_seq = f.unit_seq)"
    from . import field_queries, log_queries, name_queries, page_queries

    decoy = lambda digits, test: f"(kind is null and regexp_full_match(value, '{digits}') and {test})"
    labelled = ", ".join(f"({k}, {'null' if b[2] is None else repr(b[2])}, '{b[1]}', '{b[0]}')" for k, b in enumerate(BLOCKS))
    more = field_queries.oracle_sql(hit, decoy("[0-9]{16}", _luhn_sql("value", 16)), decoy("[2-9][0-9]{11}", _verhoeff_sql("value")), shown, tagged, labelled, n)
    return more | page_queries.oracle_sql(tagged, owned, kinds) | log_queries.oracle_sql() | name_queries.oracle_sql(clean) | {
        "r6_sanitized_turns": f"with {clean} select session_id, unit_seq, text from s",
        "r5_vault": f"with {hit} select session_id, kind, count(distinct value) as tokens, count(distinct value)::bigint as last_n from f group by 1, 2",
        "r10_withheld": f"with {hit} select session_id, kind, count(*) as withheld from f group by 1, 2",
        "l1_previews": f"with {hit} select kind, {shown} as preview, count(*) as times from f group by 1, 2",
        "l3_totals": f"with {hit} select kind, count(*) as withheld, count(distinct session_id) as sessions from f group by rollup (kind)",
        "v1_leaks": f"with {hit}, v as (select distinct session_id, value from f) select 'sanitized' as channel, 0::bigint as leaks union all select 'raw', count(*) from v join u using (session_id) where contains(u.text, v.value)",
        "d2_candidates": f"with d as ({docs}) select kind, count(*) as candidates, count(*) filter (ok) as verified, count(distinct session_id) as documents from ({d2}) group by 1",
        "d2_all_candidates": f"with d as ({docs}), c as (select kind, session_id, count(*) as n from ({d2}) group by 1, 2) select kind, case when n = 1 then 'one' when n < 10 then 'two to nine' else 'more' end as candidates, count(*) as documents from c group by 1, 2",
        "d4_aadhaar_rate": f"with r as (select lpad(cast((o_orderkey * 7919 + 234567) * 104729 % 1000000000000 as varchar), 12, '2') as d from orders) select substr(d, 1, 1) as first_digit, count(*) as numbers, count(*) filter (regexp_full_match(d, '[2-9][0-9]{{11}}') and {_verhoeff_sql('d')}) as valid from r group by 1",
        "d5_card_rate": f"with r as (select lpad(cast((o_orderkey * 104729 + 17) * 1299709 % 10000000000000000 as varchar), 16, '4') as d from orders) select substr(d, 1, 1) as first_digit, count(*) as numbers, count(*) filter ({_luhn_sql('d', 16)}) as valid from r group by 1",
        "r12_rehydrated": turns,
        "t1_injected_score": f"with b(k, kind, value) as (values {values}) select coalesce(kind, 'DECOY') as kind, count(*) as rows, count(*) filter (kind is not null) as hits, count(*) filter (kind is null and (regexp_full_match(value, '[2-9][0-9]{{11}}') and {_verhoeff_sql('value')} or regexp_full_match(value, '[0-9]{{16}}') and {_luhn_sql('value', 16)})) as false_alarms from documents join b on doc_id % {n} = k group by 1",
        "t10_text_statistics": f"with {prose} select doc_id, em, en, ellipsis, semis, words, distinct_words, hapax, sentences, round(mean_len, 6) as mean_len, round(sd_len, 6) as sd_len, short, long, opener_count, tells from r",
        "t11_text_verdict": f"""with {prose}, x as (select case when coalesce(sentences, 0) = 0 then 'FLAG' when 10000 * (sentences * sum_squares - sum_len * sum_len) >= 2025 * sum_len * sum_len then 'PASS' when 10000 * (sentences * sum_squares - sum_len * sum_len) <= 625 * sum_len * sum_len then 'FLAG' else 'MID' end as burstiness_band,
            case when em * 1000 > 1.5 * words then 'FLAG' else 'PASS' end as dash_flag, case when coalesce(opener_count, 0) <= greatest(3, coalesce(sentences, 0) // 25) then 'PASS' else 'FLAG' end as opener_flag,
            case when ellipsis > 0 then 'FLAG' else 'PASS' end as ellipsis_flag, case when tells > 0 then 'FLAG' else 'PASS' end as word_flag from r)
            select burstiness_band, dash_flag, opener_flag, ellipsis_flag, word_flag, count(*) as documents from x group by all""",
        "p1_page_tokens": f"with {tagged} select kind, tag, count(*) as tokens, count(distinct page_id) as pages from k group by 1, 2",
        "p1_page_depth": f"""with {tagged}, x as (select page_id, seq, sum(case when tag in ({flat}) then 0 when kind = 'open' then 1 when kind = 'close' then -1 else 0 end) over (partition by page_id order by seq)::bigint as depth from k)
            select page_id, max(depth) as most_depth, min(depth) as least_depth, arg_max(depth, seq) as end_depth, count(*) as tokens from x group by 1""",
        "p3_own_text": f"with {tagged}, {decoded} select tag, count(*) as elements, count(*) filter (own <> '') as with_text, sum(length(own))::bigint as chars from e group by 1",
        "p11_kept_nodes": f"""with {tagged}, {owned} select page_id, count(*) as nodes, max(length(case when tag not in ('a', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') and own <> '' then left(own, 2000) end))::int as longest_value
            from e where (tag in ('a', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') or own <> '') and tag not in ('head', 'title', 'meta', 'br', 'link') group by 1""",
        "p22_page_origin": r"""with u as (select lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)', 1) as p from pages)
            select case when s = '' or h = '' then 'about:blank' else s || '://' || h || (case when p = '' or (s = 'http' and p = '80') or (s = 'https' and p = '443') then '' else ':' || p end) end as origin, count(*) as pages from u group by 1""",
        "p24_capture_gate": f"with {tagged} select page_id, count(*) as nodes from k where kind = 'open' group by 1 having count(*) >= 100",
        "p26_questions": f"select conv_id, turn, coalesce({questions}, false) as is_question from (select conv_id, turn, regexp_replace(lower(text), '^[\\s]+|[\\s]+$', '', 'g') as g from conversations where role = 'user')",
        "v7_invented": "select distinct conv_id as session_id, '<PII_PAN_77>' as token from conversations",
    }
