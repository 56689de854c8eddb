"""Tokens and redaction (R5, R6, R10, R12, R13) and the vault.

The vault is a table of its own; sanitized units never carry a value. Values that agree are one token for
their session, whatever kind comes later; numbers count up by kind in mint order: units in order, and
within a text from the last span to the first. Sessions are matched null-safely: rows without a session
share one. Rows are matched by a digest of session, unit, field and text, so that repeated rows get the
same tokens and none is lost. Token-like text in the input is escaped (``<PII\\_``) and never rehydrated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import durable

TOKEN = "<PII_[A-Z_]+_[0-9]+>"
KEY = "__key"


def row_key(units: DataFrame, session: str, unit: str, text: str) -> Column:
    """A digest of a unit's place and text; equal rows have equal ones."""
    place = [F.col(c).alias(f"k{i}") for i, c in enumerate([session, unit, *(["field"] if "field" in units.columns else []), text])]
    return F.sha2(F.to_json(F.struct(*place)), 256)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<PII(\\*)_", r"<PII$1\\_")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<PII(\\*)\\_", "<PII$1_")


#: What a span may say beside its kind and place.
EXTRA = ("source", "confidence", "verified", "org_contact")


def valued(detected: DataFrame, text: str = "text", spans: str = "detections") -> Column:
    """The spans with the values they cover."""
    fields = [f.name for f in detected.schema[spans].dataType.elementType.fields if f.name in ("kind", "start", "end", *EXTRA)]
    return F.transform(spans, lambda d: F.struct(*(d[c].alias(c) for c in fields), F.substring(F.col(text), d["start"] + 1, d["end"] - d["start"]).alias("value")))


def occurrences(detected: DataFrame, session: str = "session_id", unit: str = "unit_seq", text: str = "text", spans: str = "detections") -> DataFrame:
    """One row for each span of each distinct unit: key, session, unit, field_rank, kind, start, end, the original value and what else the spans
    say. The result is checkpointed, as the vault and the texts both need it."""
    rows = detected.where(F.size(spans) > 0)
    rank = F.col("field_rank") if "field_rank" in detected.columns else F.lit(0)
    # Not explode(): from it Spark infers a filter on the size of the array, and would detect twice.
    rows = rows.select(row_key(detected, session, unit, text).alias(KEY), F.col(session), F.col(unit), rank.alias("field_rank"), F.explode_outer(valued(detected, text, spans)).alias("d")).where("d is not null")
    return durable(rows.select(KEY, session, unit, "field_rank", "d.*"))


def mint(found: DataFrame, session: str = "session_id", unit: str = "unit_seq") -> DataFrame:
    """The vault (session, kind, n, token, value), pre-aggregated by value before any numbering.

    Numbers are dense by session and kind, and no task sorts all values of a session: values are cut by range in mint order and counted
    by piece (one for each partition that a session and kind lies in), and a piece's numbers go on where those before it end."""
    rank = F.col("field_rank") if "field_rank" in found.columns else F.lit(0)
    place = F.struct(F.col(unit), rank.alias("r"), (-F.col("start")).alias("s"))
    values = found.groupBy(session, "value").agg(F.min(F.struct(place.alias("place"), F.col("kind"))).alias("first"))
    values = values.select(session, "value", F.col("first.kind").alias("kind"), F.col("first.place").alias("place"))
    order = [session, "kind", "place", "value"]
    ranged = durable(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).drop("place"))
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy(session, "kind", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(session, "kind").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(session).alias("__s"), F.col("kind").alias("__k"), F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__shift"))
    same = F.col(session).eqNullSafe(F.col("__s")) & (F.col("kind") == F.col("__k")) & (F.col("__part") == F.col("__p"))
    numbered = ranged.join(sizes, same).withColumn("n", (F.col("__at") + F.col("__shift")).cast("int"))
    return numbered.select(session, "kind", "n", F.concat(F.lit("<PII_"), "kind", F.lit("_"), F.col("n").cast("string"), F.lit(">")).alias("token"), "value")


def apply_tokens(units: DataFrame, found: DataFrame, vault: DataFrame, session: str = "session_id", unit: str = "unit_seq", text: str = "text") -> DataFrame:
    """``units`` with each value replaced by its token; units without a value pass unchanged, but for the
    escape of token-like text. Only spans and tokens are shuffled by session; texts meet them by row key."""
    minted = vault.select(F.col(session).alias("__s"), F.col("value").alias("__v"), "token")
    tokens = found.join(minted, F.col(session).eqNullSafe(F.col("__s")) & (F.col("value") == F.col("__v")))
    spans = tokens.groupBy(KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end", "token"))).alias("__spans"))
    joined = units.withColumn(KEY, row_key(units, session, unit, text)).join(spans, KEY, "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    gap = lambda a, n: escape(F.substring(F.col(text), a + 1, n))
    step = lambda s, x: F.struct(F.concat(s["out"], gap(s["at"], x["start"] - s["at"]), x["token"]).alias("out"), x["end"].alias("at"))
    done = F.aggregate("__spans", begin, step, lambda s: F.concat(s["out"], gap(s["at"], F.length(text))))
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), escape(F.col(text))).otherwise(done)).drop("__spans", "detections", "spans", KEY)


def rehydrate(units: DataFrame, vault: DataFrame, session: str = "session_id", text: str = "text") -> DataFrame:
    """Tokens of ``units`` replaced by the vault's values; unknown tokens stay as they are. Units without a
    token are not shuffled with it; equal texts of a session are put together once."""
    keyed = units.withColumn(KEY, F.when(F.col(text).rlike(TOKEN), F.sha2(F.to_json(F.struct(F.col(session).alias("s"), F.col(text).alias("t"))), 256)))
    texts = keyed.where(F.col(KEY).isNotNull()).select(KEY, session, text).dropDuplicates([KEY])
    pairs = F.zip_with(F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda g, t: F.struct(g.alias("gap"), t.alias("token")))
    cut = texts.select(KEY, session, F.posexplode(pairs).alias("k", "p")).select(KEY, session, "k", F.col("p.gap").alias("gap"), F.col("p.token").alias("token"))
    minted = vault.select(F.col(session).alias("__s"), F.col("token").alias("__t"), "value")
    known = cut.join(minted, F.col(session).eqNullSafe(F.col("__s")) & (F.col("token") == F.col("__t")), "left")
    part = F.struct("k", F.concat(unescape(F.col("gap")), F.coalesce("value", "token", F.lit(""))).alias("s"))
    whole = known.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("__text"))
    return keyed.join(whole, KEY, "left").withColumn(text, F.coalesce("__text", unescape(F.col(text)))).drop(KEY, "__text")


def withheld_counts(found: DataFrame, session: str = "session_id") -> DataFrame:
    """Occurrences by session and kind; where spans tell them, the site's own contact addresses are counted apart."""
    if "org_contact" not in found.columns:
        return found.groupBy(session, "kind").agg(F.count(F.lit(1)).alias("withheld"))
    own = F.coalesce("org_contact", F.lit(False))
    return found.groupBy(session, "kind").agg(F.count_if(~own).alias("withheld"), F.count_if(own).alias("org_contacts"))


def resolve_tokens(actions: DataFrame, vault: DataFrame, session: str = "session_id", text: str = "text") -> DataFrame:
    """``value`` where a text is one whole token of its session's vault, and ``status``: ok, unknown token or literal."""
    minted = vault.select(F.col(session).alias("__s"), F.col("token").alias("__t"), "value")
    whole = F.trim(F.col(text))
    joined = actions.join(minted, F.col(session).eqNullSafe(F.col("__s")) & (whole == F.col("__t")), "left").drop("__s", "__t")
    status = F.when(~whole.rlike(f"^{TOKEN}$") | whole.isNull(), "literal").when(F.col("value").isNull(), "unknown token").otherwise("ok")
    return joined.withColumn("status", status)
