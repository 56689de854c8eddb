"""Pattern detection (D1 to D3, D10 to D12): from a text to an array of detections, all in Catalyst.

A detection is struct<kind, start, end, raw, verified, confidence> with code-point offsets from 0 into the
original text. A text is cut into lines, and lines that pass a cheap test into regions, the runs of characters in which
alone a rule can match (see ``REGION``); only these are scanned by the rules, and positions within the text are worked
out only where a detection stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums
from .kept import once

#: An ASCII word boundary; Java's own one also counts other scripts' letters as word characters.
EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: White space of other scripts, which Java's own class leaves out; it is scanned as line ends.
WIDE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a text that folding changes holds; told in two comparisons a character.
BEYOND = r"[\xa0\xad\u0100-\x{10ffff}]"
_HOLDS = r"[^\s0-9@]*+[0-9@]\S*+"
#: Words with a digit or an at sign, and such words after them with blanks and hyphens between. No rule has a
#: match that reaches beyond one: all white space that rules allow is the blank, between digits.
REGION = rf"(?<=\s|^){_HOLDS}(?:[ -]+{_HOLDS})*+"
#: What a region must hold: a rule's scarcest part.
PROMISING = "@|(?:[0-9][ -]*+){10}|[A-Za-z]{4}0|[A-Za-z]{5}[0-9]{4}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    priority: int
    sure: float
    unsure: float
    #: Texts that don't match this cheap guard have no candidate.
    guard: str


# Patterns, priorities and confidences of the kinds.
RULES = [
    Rule("CARD", f"{EDGE}(?:[0-9][ -]*?){{13,19}}{EDGE}", 100, 0.98, 0.25, "(?:[0-9][ -]*+){13}"),
    Rule("AADHAAR", f"{EDGE}[2-9][0-9]{{3}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}{EDGE}", 90, 0.97, 0.2, "(?:[0-9][ -]?){12}"),
    Rule("GSTIN", f"(?i){EDGE}[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]{EDGE}", 85, 0.99, 0.4, "[0-9][A-Za-z]{5}[0-9]{4}"),
    Rule("PAN", f"(?i){EDGE}[A-Z]{{5}}[0-9]{{4}}[A-Z]{EDGE}", 80, 0.95, 0.35, "[A-Za-z]{5}[0-9]{4}"),
    Rule("IFSC", f"(?i){EDGE}[A-Z]{{4}}0[A-Z0-9]{{6}}{EDGE}", 75, 0.95, 0.4, "[A-Za-z]{4}0"),
    Rule("EMAIL", f"{EDGE}[^\\s@]+@[^\\s@.]+\\.[^\\s@,;]{{2,}}{EDGE}", 70, 0.95, 0.5, "@"),
    Rule("UPI", f"{EDGE}[a-zA-Z0-9._-]{{2,64}}@[a-zA-Z][a-zA-Z0-9]{{1,29}}{EDGE}", 65, 0.85, 0.3, "@"),
    Rule("PHONE", f"(?:\\+?91[ -]?)?{EDGE}[6-9][0-9]{{4}}[ -]?[0-9]{{5}}{EDGE}", 60, 0.9, 0.3, "[6-9][0-9]{4}[ -]?[0-9]{5}"),
]

# Characters that take no space, and letters and digits drawn like Latin ones.
INVISIBLE = "­​‌‍‎‏⁠⁦⁧⁨⁩﻿"
CYRILLIC = ("АВЕКМНОРСТУХЅІЈ", "ABEKMHOPCTYXSIJ")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")
FULLWIDTH = ("".join(chr(0xFF10 + k) for k in range(10)), "0123456789")

_BY_START = "array<struct<start:int,end:int,kind:string,raw:string,verified:boolean,confidence:double>>"
DETECTION = "array<struct<kind:string,start:int,end:int,raw:string,verified:boolean,confidence:double>>"
_PLACED = "array<struct<start:int,raw:string>>"
_SCORED = "array<struct<kind:string,start:int,end:int,raw:string,verified:boolean,confidence:double,priority:int>>"


def fold(text: Column) -> Column:
    """The text without invisible characters, with look-alikes as their Latin forms."""
    look = CYRILLIC[0] + GREEK[0] + FULLWIDTH[0]
    return F.translate(text, look + INVISIBLE, CYRILLIC[1] + GREEK[1] + FULLWIDTH[1])


def place_all(text: Column, pattern: str, found: Column | None = None) -> Column:
    """array<struct<start, raw>> of a pattern's matches: the gaps that split leaves say where they stand."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if found is None else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda gap, raw: F.struct(F.length(gap).alias("gap"), raw.alias("raw")))
    begin = F.struct(F.array().cast(_PLACED).alias("out"), F.lit(0).alias("at"))

    def place(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        return F.struct(F.concat(state["out"], F.array(F.struct(start.alias("start"), pair["raw"].alias("raw")))).alias("out"), (start + F.length(pair["raw"])).alias("at"))

    return F.aggregate(pairs, begin, place, lambda s: s["out"])


def scannable(text: Column) -> Column:
    """The folded text with all wide white space as line ends; as long as the folded text. Only texts that may hold a character to change are translated:
    all of these are no-break blanks, soft hyphens or beyond Latin-1."""
    look = CYRILLIC[0] + GREEK[0] + FULLWIDTH[0]
    # Characters that stand for others come first, those that go last: translate drops what has no counterpart.
    changed = F.translate(text, look + WIDE + INVISIBLE, CYRILLIC[1] + GREEK[1] + FULLWIDTH[1] + "\n" * len(WIDE))
    return F.when(text.rlike(BEYOND), changed).otherwise(text)


def lines(scanned: Column) -> Column:
    """The lines of a scannable text; those that can't hold a match are empty strings."""
    return F.transform(F.split(scanned, "\n"), lambda s: F.when(s.rlike("[0-9@]") & s.rlike(PROMISING), s).otherwise(""))


def regions(scanned: Column) -> Column:
    """The texts of all regions of promising lines, in order."""
    return F.flatten(F.transform(lines(scanned), lambda s: F.when(s != "", F.regexp_extract_all(s, F.lit(REGION), F.lit(0))).otherwise(F.array().cast("array<string>"))))


def _candidates(region: Column, rule: Rule) -> Column:
    """Verified and scored candidates of a rule in a region, without those inside a decimal number."""

    def score(m: Column) -> Column:
        verified = checksums.CHECKS[rule.kind](m["raw"])
        unsure: Column = F.lit(rule.unsure)
        if rule.kind == "AADHAAR":
            unsure = F.when(m["raw"].rlike("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$"), F.lit(0.65)).otherwise(unsure)
        if rule.kind == "CARD":
            unsure = F.when(m["raw"].rlike("^[0-9]{4}([ -][0-9]{4}){3}$"), F.lit(0.65)).otherwise(unsure)
        return F.struct(
            F.lit(rule.kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["raw"])).alias("end"), m["raw"].alias("raw"),
            verified.alias("verified"), F.when(verified, F.lit(rule.sure)).otherwise(unsure).alias("confidence"), F.lit(rule.priority).alias("priority"),
        )

    found = place_all(region, rule.pattern)
    if rule.kind in ("CARD", "AADHAAR", "PHONE"):
        before = lambda m: F.substring(region, F.greatest(m["start"] - 1, F.lit(1)), F.least(m["start"], F.lit(2)))
        after = lambda m: F.substring(region, m["start"] + F.length(m["raw"]) + 1, F.lit(2))
        found = F.filter(found, lambda m: ~(before(m).rlike(r"[0-9]\.$") | after(m).rlike(r"^\.[0-9]")))
    return F.when(region.rlike(rule.guard), F.transform(found, score)).otherwise(F.array().cast(_SCORED))


def _resolve(candidates: Column) -> Column:
    """Verified first, then priority, then length; each is kept unless it overlaps a kept one."""
    ranked = F.array_sort(F.transform(candidates, lambda c: F.struct((~c["verified"]).alias("r1"), (-c["priority"]).alias("r2"), (c["start"] - c["end"]).alias("r3"), c["start"].alias("r4"), c.alias("c"))))
    kept = lambda acc, x: F.when(F.exists(acc, lambda a: (a["start"] < x["c"]["end"]) & (x["c"]["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(x["c"])))
    found = F.aggregate(ranked, F.array().cast(_SCORED), kept)
    return F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["raw"].alias("raw"), c["verified"].alias("verified"), c["confidence"].alias("confidence"))))


def with_detections(units: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """``units`` with ``detections``, those of at least ``least`` confidence, by start.

    A null text has none. Lines and regions don't overlap, so overlaps are settled region by region; texts
    without any detection stop there."""
    units = once(units, __folded=scannable(F.coalesce(F.col(text), F.lit(""))))
    folded = F.col("__folded")
    # Whole texts are asked only for what is cheap to tell; the scarcer parts are looked for in lines that have it.
    units = once(units, __lines=F.when(folded.rlike("[0-9@]"), F.split(folded, "\n")))

    def move(d: Column, by: Column) -> Column:
        return F.struct((d["start"] + by).alias("start"), (d["end"] + by).alias("end"), *(d[c].alias(c) for c in ("kind", "raw", "verified", "confidence")))

    def scan(p: Column) -> Column:
        found = F.when(p["raw"].rlike(PROMISING), _resolve(F.flatten(F.array(*(_candidates(p["raw"], r) for r in RULES)))))
        return F.coalesce(F.transform(F.filter(found, lambda d: d["confidence"] >= least), lambda d: move(d, p["start"])), F.array().cast(_BY_START))

    none = F.array().cast(_BY_START)
    promising = lambda s: s.rlike("[0-9@]") & s.rlike(PROMISING)
    units = once(units, __found=F.transform("__lines", lambda s: F.when(promising(s), F.flatten(F.transform(place_all(s, REGION), scan))).otherwise(none)))
    some = F.exists("__found", lambda d: F.size(d) > 0)
    sized = F.zip_with("__found", "__lines", lambda own, s: F.struct(own.alias("own"), (F.length(s) + 1).alias("n")))
    begin = F.struct(none.alias("out"), F.lit(0).alias("at"))
    further = lambda t, x: F.struct(F.when(F.size(x["own"]) > 0, F.concat(t["out"], F.transform(x["own"], lambda d: move(d, t["at"])))).otherwise(t["out"]).alias("out"), (t["at"] + x["n"]).alias("at"))
    units = once(units, __moved=F.when(some, F.aggregate(sized, begin, further, lambda t: t["out"])))
    # Offsets of the original text: the k-th visible character's place, only where folding dropped any.
    shorter = F.length(folded) < F.length(text)
    places = F.filter(F.transform(F.split(F.col(text), ""), lambda c, i: F.when(F.instr(F.lit(INVISIBLE), c) == 0, i)), lambda i: i.isNotNull())
    units = once(units, __places=F.when(shorter & (F.size("__moved") > 0), places))
    at = lambda k: F.when(F.col("__places").isNull(), k).otherwise(F.coalesce(F.try_element_at("__places", k + 1), F.length(text)))
    back = F.transform("__moved", lambda d: F.struct(d["kind"].alias("kind"), at(d["start"]).alias("start"), at(d["end"]).alias("end"), d["raw"].alias("raw"), d["verified"].alias("verified"), d["confidence"].alias("confidence")))
    return once(units, detections=F.coalesce(back, F.array().cast(DETECTION))).drop("__folded", "__lines", "__found", "__moved", "__places")
