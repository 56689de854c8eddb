"""Character references of HTML in SQL, by the rules that ``html.unescape`` follows where the tree is read."""

from __future__ import annotations

import html
import html.entities

NAMED = html.entities.html5
#: Names that stand without a semicolon too, longer ones first, as the longest that fits is read.
LOOSE = sorted((n for n in NAMED if not n.endswith(";")), key=lambda n: (-len(n), n))
PIECES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: Numbers that don't stand for their own character: controls, those of an old code page, and such that are no characters. Surrogates and numbers too large are told by range.
NUMBERS = [k for k in (*range(0xA0), *range(0xFDD0, 0xFDF0), *(p + e for p in range(0, 0x110000, 0x10000) for e in (0xFFFE, 0xFFFF))) if html.unescape(f"&#{k};") != chr(k)]
#: White space as the tree collapses it.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _text(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in value) if value else "''"


def sql_decoded(name: str, rows: str, keys: str, text: str) -> str:
    """Common tables that end in ``name``: ``keys`` (unique in ``rows``) and ``text`` of ``rows``, references read; an empty text has no row."""
    named = ", ".join(f"('{n}', {_text(c)})" for n, c in NAMED.items())
    numbers = " ".join(f"when {k} then {_text(html.unescape(f'&#{k};'))}" for k in NUMBERS)
    number = r"coalesce(case when regexp_matches(piece, '^&#[xX]') then try_cast('0x' || regexp_extract(piece, '^&#[xX]0*([0-9a-fA-F]*)', 1) as bigint) when regexp_matches(piece, '^&#') then try_cast(regexp_extract(piece, '^&#([0-9]+)', 1) as bigint) end, 1114112)"
    return f"""{name}_named(ref, says) as (values {named}),
        {name}_cut as (select {keys}, unnest(l) as piece, generate_subscripts(l, 1) as i from (select {keys}, regexp_extract_all({text}, '{PIECES}') as l from {rows})),
        {name}_told as (select *, case when starts_with(piece, '&#') and length(piece) > 2 then {number} end as code, case when regexp_matches(piece, '^&[^#]') then piece[2:] end as whole, case when regexp_matches(piece, '^&[^#]') then regexp_extract(piece, '^&({"|".join(LOOSE)})', 1) end as loose from {name}_cut),
        {name} as (select {keys}, string_agg(case when code between 55296 and 57343 or code > 1114111 then chr(65533) when code is not null then case code {numbers} else chr(code::int) end when a.says is not null then a.says when b.says is not null then b.says || piece[length(loose) + 2:] else piece end, '' order by i) as {text}
            from {name}_told left join {name}_named a on whole = a.ref left join {name}_named b on loose = b.ref group by {keys})"""
