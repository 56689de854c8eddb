"""Queries of names end to end (N1 to N4, N6, N7) and of payloads (K1) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary
from ..operators import names
from ..sources.readers import conversation_units, spread, table
from .field_queries import FAMILY, GIVEN, ORDINARY, name_lists

#: A line for each turn, by its ids: names of every rule, words that are none, offices beside names.
LINES = [
    "Resident: Ananya Sharma, Lake Road", "Signed Rajesh Quillfeather today", "Brondo Gupta and Maria Smith", "Anna", "Patel Reddy of the north", "Zyxel Quorvane wrote", "Office Manager North Street", "Dear Mr Vikram Nair",
    "Priya-Lakshmi Verma", "Sharma Gupta Private Limited", "Maria John Garcia", "the State Bank of Deepa Shah", "Arjun  Bajpai", "Arjun   Bajpai", "no names here", "Harsh Verma Harsh Verma Harsh", "Station House Colony", "Peter Total",
]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = conversation_units(spread(table(spark, sf_dir, "conversations")))
    line = F.array(*(F.lit(x) for x in LINES))[F.pmod(F.col("session_id") + F.col("unit_seq") * 3, F.lit(len(LINES))).cast("int")]
    return units.select("session_id", "unit_seq", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))


def n1_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words are given names, family names and ordinary words of the corpus, by first letter."""
    return name_lists(spark, sf_dir).groupBy(F.substring("word", 1, 1).alias("letter"), "given", "family", "ordinary").agg(F.count(F.lit(1)).alias("words"))


def n3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all turns with a line, each with its place, confidence and rule."""
    found = names.with_names(_units(spark, sf_dir), name_lists(spark, sf_dir))
    return found.select("session_id", "unit_seq", F.inline_outer("names")).where("start is not null").select("session_id", "unit_seq", "start", "text", F.round("confidence", 6).alias("confidence"), "reason")


def n9_turn_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names and blocks of prose by conversation, and whether it is one about many people."""
    return names.prose_names(names.with_names(_units(spark, sf_dir), name_lists(spark, sf_dir)))


QUERIES = [n1_word_lists, n3_names, n9_turn_density]


def oracle_sql(clean: str) -> dict[str, str]:
    """SQL by query; ``clean`` are the common tables of sanitized turns (s)."""
    quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
    listed = lambda ws, least, most, flag: f"select distinct lower(trim(w)) as w, '{flag}' as flag from (select unnest([{quoted(ws)}]) as w) where length(trim(w)) between {least} and {most}"
    # A word that the lists take is of letters, hyphens and apostrophes.
    lists = rf"""seen as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\b([a-z][a-z''-]{{2,13}})(?:[^0-9A-Za-z_]|$)', 1))) as w from documents), learned as (select w from seen group by 1 having count(distinct doc_id) >= 3),
        flagged as ({listed(GIVEN, 3, 99, 'given')} union all {listed(FAMILY, 4, 99, 'family')} union all {listed(ORDINARY, 3, 14, 'ordinary')} union all select w, 'ordinary' from learned),
        lists as (select w as word, bool_or(flag = 'given') as given, bool_or(flag = 'family') as family, bool_or(flag = 'ordinary') as ordinary from flagged where regexp_full_match(w, '[a-z][a-z''-]*') group by 1)"""
    shape = "\\b[A-Z][a-z''’-]{0,23}[a-z]\\b"
    # The rules look at a word (a) and the next (b); what is used up is walked over by recursion.
    found = f"""with recursive {lists}, line(k, line) as (values {', '.join(f"({k}, '{x}')" for k, x in enumerate(LINES))}),
        units as (select conv_id as session_id, turn as unit_seq, coalesce(text, '') || chr(10) || line as text from conversations join line on k = (conv_id + turn * 3) % {len(LINES)}),
        cut as (select *, regexp_extract_all(text, '{shape}') as raws, regexp_split_to_array(text, '{shape}') as gaps from units where length(text) <= 2000),
        every as (select session_id, unit_seq, text, unnest(raws) as raw, generate_subscripts(raws, 1) as i, gaps from cut),
        placed as (select *, coalesce(sum(length(raw)) over (partition by session_id, unit_seq order by i rows between unbounded preceding and 1 preceding), 0) + list_sum(list_transform(gaps[1:i], lambda g: length(g))) as start, replace(lower(raw), '’', '''') as word from every),
        kept as (select p.*, coalesce(given, false) as given, coalesce(family, false) as family, coalesce(ordinary, false) as ordinary, row_number() over (partition by session_id, unit_seq order by i) as nth from placed p left join lists using (word) where word not in ({quoted([*vocabulary.NOT_NAMES, *vocabulary.COMMON_WORDS])})),
        pairs as (select a.session_id, a.unit_seq, a.nth, a.text as whole, a.start::int as start, a.raw, a.raw || coalesce(a.gaps[a.i + 1] || b.raw, '') as pair, a.given, a.family, b.given as b_given, b.family as b_family, b.ordinary as b_ordinary,
            coalesce(b.i = a.i + 1 and regexp_full_match(a.gaps[a.i + 1], '[\\s-]{{0,2}}'), false) as near, length(a.raw) >= 3 and not a.ordinary and not b.ordinary as long, length(b.raw) >= 3 as b_long
            from kept a left join kept b on a.session_id = b.session_id and a.unit_seq = b.unit_seq and b.nth = a.nth + 1),
        ruled as (select *, case when near and given and (b_family or b_given) then ('list:given+list', 0.9, 2) when near and given and not b_ordinary then ('list:given+unlisted', 0.75, 2) when near and not given and not family and b_family and long then ('unlisted+list:family', 0.75, 2)
            when given then ('list:given-alone', 0.45, 1) when near and not given and not b_given and not family and not b_family and long and b_long then ('unlisted+unlisted', 0.7, 2) when near and family and b_family then ('list:family+family', 0.5, 2) end as rule from pairs),
        walk as (select session_id, unit_seq, 1::bigint as nth from ruled where nth = 1 union all select w.session_id, w.unit_seq, w.nth + coalesce(r.rule[3], 1)::bigint from walk w join ruled r using (session_id, unit_seq, nth)),
        named as (select session_id, unit_seq, start, case when rule[3] = 2 then pair else raw end as text, rule[2]::double as sure, rule[1] as why, whole from walk join ruled using (session_id, unit_seq, nth) where rule is not null),
        judged as (select *, list_has_any(regexp_extract_all(lower(substr(whole, greatest(start - 40, 0) + 1, start + length(text) + 40 - greatest(start - 40, 0))), '[a-z]+'), [{quoted(vocabulary.ORGANISATIONS)}]) as office from named),
        names as (select session_id, unit_seq, start, text, round(case when office then sure * 0.4::double else sure end, 6) as confidence, case when office then why || ':near-organisation' else why end as reason from judged)"""
    return {
        "n1_word_lists": f"with {lists} select word[1] as letter, given, family, ordinary, count(*) as words from lists group by all",
        "n3_names": f"{found} select session_id, unit_seq, start, text, confidence, reason from names",
        "n9_turn_density": f"""{found}, prose as (select session_id, unit_seq from units where length(text) > 120), d as (select session_id, count(distinct n.text) filter (confidence >= 0.6) as names from prose join names n using (session_id, unit_seq) group by 1)
            select session_id, coalesce(names, 0) as names, blocks, coalesce(names, 0) > 6 as reference from (select session_id, count(*) as blocks from prose group by 1) left join d using (session_id)""",
        "k1_payloads": f"with {clean}, j as (select session_id, to_json(list({{'unit_seq': unit_seq, 'text': text}} order by unit_seq))::varchar as payload from s group by 1) select session_id, payload, octet_length(encode(payload))::int as payload_bytes from j",
    }
