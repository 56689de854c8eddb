"""Ledger and leak audits.

Where secrets are looked for in texts of their session, both come together by session, and a text is read once beside an
automaton of all the session's secrets (``search``). V1, V3, V6 and R7 are what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search
from .vault import TOKEN


def masked(kind: Column, value: Column) -> Column:
    """L1: a preview that shows at most the first two and the last character."""
    # Bullets of a preview.
    value = F.trim(value)
    dot, n = F.lit("•"), F.length(value)
    long = F.concat(F.left(value, F.lit(2)), F.repeat(dot, F.least(F.lit(12), n - 3)), F.right(value, F.lit(1)))
    return F.when(kind == "PASSWORD", F.repeat(dot, F.lit(8))).when(n <= 4, F.repeat(dot, F.greatest(F.lit(3), n))).otherwise(long)


def entries(found: DataFrame, session: str = "session_id", unit: str = "unit_seq", most: int = 5) -> DataFrame:
    """L2: by session and kind how many values were withheld, and previews of the first ``most`` distinct values."""
    place = F.struct(F.col(unit), F.col("start"))
    values = found.groupBy(session, "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    nth = F.row_number().over(Window.partitionBy(session, "kind").orderBy("place"))
    shown = F.when(F.col("nth") <= most, F.struct("nth", masked(F.col("kind"), F.col("value")).alias("preview")))
    rows = values.withColumn("nth", nth).groupBy(session, "kind").agg(F.sum("n").alias("withheld"), F.array_sort(F.collect_list(shown)).alias("shown"))
    return rows.select(session, "kind", "withheld", F.transform("shown", lambda s: s["preview"]).alias("previews"))


def totals(ledger: DataFrame) -> DataFrame:
    """L3: what was withheld by kind, and over all kinds (kind null), largest first."""
    return ledger.rollup("kind").agg(F.sum("withheld").alias("withheld"), F.count_distinct("session_id").alias("sessions"))


def retain(ledger: DataFrame, at: str, most: int = 200) -> DataFrame:
    """L4: the ``most`` latest entries; a report of bounded size by its purpose."""
    return ledger.orderBy(F.desc(at)).limit(most)


def field_view(units: DataFrame, text: str = "text") -> DataFrame:
    """Values and, of labels, those with six digits in a row or a token; ``verdict`` says whether anything was withheld."""
    shown = (F.col("field") == "value") | F.col(text).rlike("[0-9]{6,}|<PII_")
    verdict = F.when(F.col(text).rlike(TOKEN), "withheld").otherwise("sent as it is")
    return units.where(shown & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).withColumn("verdict", verdict)


def leaks(vault: DataFrame, wire: DataFrame, session: str = "session_id", text: str = "text", sizes: DataFrame | None = None) -> DataFrame:
    """V1: vault values that still stand in their session's outgoing text, literally or, from six
    characters on, without separators and case. The result carries the token only, once for each row of ``wire`` that has it."""
    found = search.found_in(vault.select(session, "token", "value"), wire, session, text, sizes=sizes).where("literal or loose")
    return found.select(session, "secret.token", F.when(F.col("literal"), "literal").otherwise("normalized").alias("how"))


# The patterns of the residue and echo audits, the most specific first.
RESIDUE = [("CARD", r"\b(?:[0-9][ -]?){13,19}\b"), ("AADHAAR", r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"), ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), ("EMAIL", r"\b[^\s@]+@[^\s@.]+\.[^\s@,;]{2,}\b")]


def residue(clean: DataFrame, acknowledged: DataFrame | None = None, keys: tuple[str, ...] = ("session_id", "unit_seq"), text: str = "text") -> DataFrame:
    """V2: rows of ``clean`` in which a raw pattern is left once tokens are taken out, by kind, but for those
    acknowledged (``keys`` and kind) as looked at and kept."""
    bare_text = F.regexp_replace(F.col(text), TOKEN, "")
    kinds = F.array_compact(F.array(*(F.when(bare_text.rlike(p), F.lit(k)) for k, p in RESIDUE)))
    found = clean.select(*keys, F.explode(kinds).alias("kind"))
    if acknowledged is None:
        return found
    known = acknowledged.select(*(F.col(k).alias(f"__{k}") for k in (*keys, "kind"))).distinct()
    on = F.col("kind") == F.col("__kind")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(known, on, "left_anti")


def transcript(vault: DataFrame, wire: DataFrame, session: str = "session_id", text: str = "text", sizes: DataFrame | None = None) -> DataFrame:
    """V3: by session how many of its vault's values (three characters or more) were checked and how many stand in its
    texts as they are, with JSON escapes, or without separators; a session with none checked is not clean but unchecked."""
    checked = vault.where(F.length("value") >= 3).select(session, "token", "value")
    hits = search.found_in(checked, wire, session, text, sizes=sizes).groupBy(session).agg(F.count_distinct("secret.token").alias("leaked"))
    counts = checked.groupBy(session).agg(F.count(F.lit(1)).alias("checked"))
    sessions = wire.select(session).distinct()
    c, h = counts.withColumnRenamed(session, "__c"), hits.withColumnRenamed(session, "__h")
    out = sessions.join(c, F.col(session).eqNullSafe(F.col("__c")), "left")
    out = out.join(h, F.col(session).eqNullSafe(F.col("__h")), "left")
    n, bad = F.coalesce("checked", F.lit(0)), F.coalesce("leaked", F.lit(0))
    return out.select(session, n.alias("checked"), bad.alias("leaked"), F.when(n == 0, "unchecked").when(bad > 0, "leaked").otherwise("clean").alias("verdict"))


def channels(found: DataFrame, masks: DataFrame, images: DataFrame, session: str = "session_id") -> DataFrame:
    """V4: sessions that send an image and withhold values need a mask; by session of ``images`` its values, masks and verdict."""
    values = found.groupBy(F.col(session).alias("__v")).agg(F.count(F.lit(1)).alias("values"))
    drawn = masks.groupBy(F.col(session).alias("__m")).agg(F.count(F.lit(1)).alias("masks"))
    own = images.select(session).distinct()
    out = own.join(values, F.col(session).eqNullSafe(F.col("__v")), "left").join(drawn, F.col(session).eqNullSafe(F.col("__m")), "left")
    v, m = F.coalesce("values", F.lit(0)), F.coalesce("masks", F.lit(0))
    return out.select(session, v.alias("values"), m.alias("masks"), F.when(v == 0, "nothing to cover").when(m > 0, "covered").otherwise("uncovered").alias("verdict"))


def echoed(text: Column) -> Column:
    """V5: the most specific kind of raw value that a text carries, or null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in RESIDUE))


def disguised_left(clean: DataFrame, planted: DataFrame, session: str = "session_id", text: str = "text", sizes: DataFrame | None = None) -> DataFrame:
    """V6: planted disguised values (``what``, ``value``) that still stand literally in their session's sanitized text."""
    found = search.found_in(planted.select(session, "what", "value"), clean, session, text, sizes=sizes).where("literal")
    return found.select(session, "secret.what").distinct()


def invented_tokens(texts: DataFrame, vault: DataFrame, session: str = "session_id", text: str = "text") -> DataFrame:
    """V7: tokens quoted in a session's texts that its vault never minted."""
    quoted = texts.select(session, F.explode(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))).alias("token")).distinct()
    known = vault.select(F.col(session).alias("__s"), F.col("token").alias("__t"))
    return quoted.join(known, F.col(session).eqNullSafe(F.col("__s")) & (F.col("token") == F.col("__t")), "left_anti")
