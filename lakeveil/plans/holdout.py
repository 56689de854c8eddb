"""Deterministic injection of labelled values (T6): units with one more line, by id modulo the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, values, kind (None for a decoy).
BLOCKS = [
    ("PAN", "ABCPE1234F", "PAN"),
    ("Aadhaar", "2345 6789 0124", "AADHAAR"),
    ("GSTIN", "27AAPFU0939F1ZV", "GSTIN"),
    ("Card", "4111 1111 1111 1111", "CARD"),
    ("IFSC", "HDFC0001234", "IFSC"),
    ("Mobile", "+91 98765 43210", "PHONE"),
    ("UPI", "ananya@okaxis", "UPI"),
    ("Mail", "ananya.rao@example.co.in", "EMAIL"),
    ("Amount", "999999999999", None),
    ("Reference", "123456789012", None),
    ("Tracking", "4539578763621486", None),
    ("Ratio", "5.666666666666667", None),
]


def block(key: Column, part: int) -> Column:
    """A part of the block (0 label, 1 value, 2 kind) that falls to a row by its id."""
    n, out = F.pmod(key, F.lit(len(BLOCKS))), F.lit(None).cast("string")
    for k, b in enumerate(BLOCKS):
        out = F.when(n == k, F.lit(b[part]).cast("string")).otherwise(out)
    return out


def inject(units: DataFrame, key: str = "session_id", text: str = "text") -> DataFrame:
    line = F.concat(F.lit("\n"), block(F.col(key), 0), F.lit(": "), block(F.col(key), 1))
    return units.withColumn(text, F.concat(F.coalesce(F.col(text), F.lit("")), line))


def sql_inject(key: str, text: str) -> str:
    """The same in SQL."""
    cases = " ".join(f"when {k} then '{b[0]}: {b[1]}'" for k, b in enumerate(BLOCKS))
    return f"coalesce({text}, '') || chr(10) || (case {key} % {len(BLOCKS)} {cases} end)"
