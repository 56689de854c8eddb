"""Check digits and structural rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dihedral_tables() -> tuple[list[int], list[int]]:
    """The D5 multiplication table (row-major, 10 x 10) and the eight powers of the check permutation
    (row-major, 8 x 10), both built from their rules."""

    def times(a: int, b: int) -> int:
        turned, flip = a % 5, a >= 5
        other = b % 5
        same = (turned - other if flip else turned + other) % 5
        return same + 5 * (flip != (b >= 5))

    # Fixed value: the permutation of the scheme.
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    power, powers = list(range(10)), []
    for _ in range(8):
        powers += power
        power = [first[k] for k in power]
    return [times(a, b) for a in range(10) for b in range(10)], powers


def verhoeff(digits: Column) -> Column:
    """Whether a string of digits carries a valid dihedral check digit."""
    times, powers = (F.array(*(F.lit(v) for v in t)) for t in dihedral_tables())
    step = lambda c, i: F.element_at(times, c * 10 + F.element_at(powers, (i % 8) * 10 + F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") + 1) + 1)
    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0), step) == 0)


def bare_digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[ -]", "")


def is_aadhaar(raw: Column) -> Column:
    d = bare_digits(raw)
    return F.when(d.rlike("^[2-9][0-9]{11}$"), verhoeff(d)).otherwise(False)


def is_card(raw: Column) -> Column:
    d = bare_digits(raw)
    return F.when(d.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", d)).otherwise(False)


def is_gstin(raw: Column) -> Column:
    """Weights 1 and 2 alternate over the first 14 characters in base 36; quotient and rest add up."""
    s = F.upper(F.trim(raw))
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(s, i, F.lit(1))).cast("int") - 1

    def add(total: Column, i: Column) -> Column:
        product = value(i) * (F.lit(2) - i % 2)
        return total + F.floor(product / 36).cast("int") + product % 36

    check = (36 - F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), add) % 36) % 36
    return F.when(s.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), check == value(F.lit(15))).otherwise(False)


def is_pan(raw: Column) -> Column:
    return F.upper(F.trim(raw)).rlike("^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$")


def is_ifsc(raw: Column) -> Column:
    return F.upper(F.trim(raw)).rlike("^[A-Z]{4}0[A-Z0-9]{6}$")


def is_upi(raw: Column) -> Column:
    return F.trim(raw).rlike("^[a-zA-Z0-9._-]{2,64}@[a-zA-Z][a-zA-Z0-9]{1,29}$")


def is_mobile(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, "[ ()-]", ""), r"^(\+91|91|0)", "").rlike("^[6-9][0-9]{9}$")


def is_email(raw: Column) -> Column:
    return F.trim(raw).rlike(r"^[^\s@]+@[^\s@.]+\.[^\s@]{2,}$")


CHECKS = {"CARD": is_card, "AADHAAR": is_aadhaar, "GSTIN": is_gstin, "PAN": is_pan, "IFSC": is_ifsc, "EMAIL": is_email, "UPI": is_upi, "PHONE": is_mobile}


def verify(kind: Column, raw: Column) -> Column:
    """The kind's own check; false for kinds that have none."""
    out = F.lit(False)
    for name, check in CHECKS.items():
        out = F.when(kind == name, check(raw)).otherwise(out)
    return out
