"""Check-digit validators as native column expressions.

Each takes a string column holding the candidate token and returns a boolean
column.  Separators ('-', ' ', '.') are ignored.  All folds run in the JVM
through ``transform``/``aggregate``; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def digit_array(d: Column) -> Column:
    """'4111' -> [4, 1, 1, 1]; callers make sure ``d`` is non-empty."""
    return F.transform(F.sequence(F.lit(1), F.length(d)),
                       lambda i: F.substr(d, i, F.lit(1)).cast("int"))


def _weighted(d: Column, weights: list[int]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(digit_array(d), w, lambda a, b: F.coalesce(a * b, F.lit(0))),
                       F.lit(0), lambda a, b: a + b)


def luhn_ok(c: Column) -> Column:
    """Luhn mod-10 check (payment cards)."""
    d = only_digits(c)
    n = F.length(d)

    def term(i):
        x = F.substr(d, i, F.lit(1)).cast("int")
        doubled = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return F.when((n - i) % 2 == 1, doubled).otherwise(x)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, b: a + b)
    return (n >= 2) & (total % 10 == 0)


def iban_ok(c: Column) -> Column:
    """ISO 13616 mod-97: move four characters to the end, letters -> 10..35."""
    s = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    r = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    chars = F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(1)))

    def step(acc, ch):
        is_digit = ch.rlike("^[0-9]$")
        letter = (F.ascii(ch) - 55).cast("long")
        return F.when(is_digit, (acc * 10 + ch.cast("long")) % 97).otherwise((acc * 100 + letter) % 97)

    return (F.length(s) >= 15) & (F.aggregate(chars, F.lit(0).cast("long"), step) == 1)


def aba_routing_ok(c: Column) -> Column:
    """US ABA routing number: weights 3,7,1 repeated, sum mod 10 == 0."""
    d = only_digits(c)
    return (F.length(d) == 9) & (_weighted(d, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0)


def nhs_ok(c: Column) -> Column:
    """UK NHS number: weights 10..2 on nine digits, check = 11 - sum mod 11."""
    d = only_digits(c)
    rest = _weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2, 0]) % 11
    check = F.when(rest == 0, F.lit(0)).otherwise(11 - rest)
    return (F.length(d) == 10) & (check != 10) & (check == F.substr(d, F.lit(10), F.lit(1)).cast("int"))


def au_tfn_ok(c: Column) -> Column:
    """Australian tax file number: weights 1,4,3,7,5,8,6,9,10, sum mod 11 == 0."""
    d = only_digits(c)
    return (F.length(d) == 9) & (_weighted(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)


def au_medicare_ok(c: Column) -> Column:
    """Australian Medicare number: weights 1,3,7,9,1,3,7,9 mod 10 == 9th digit."""
    d = only_digits(c)
    check = F.substr(d, F.lit(9), F.lit(1)).cast("int")
    return ((F.length(d) == 10) & F.substr(d, F.lit(1), F.lit(1)).isin("2", "3", "4", "5", "6")
            & (_weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 0, 0]) % 10 == check))


def ssn_ok(c: Column) -> Column:
    """US SSN ranges: area not 000, 666 or 9xx; group not 00; serial not 0000."""
    d = only_digits(c)
    area, grp, serial = F.substr(d, F.lit(1), F.lit(3)), F.substr(d, F.lit(4), F.lit(2)), F.substr(d, F.lit(6), F.lit(4))
    return ((F.length(d) == 9) & ~area.isin("000", "666") & ~area.startswith("9")
            & (grp != "00") & (serial != "0000"))


def itin_ok(c: Column) -> Column:
    """US ITIN: 9xx, middle group 50-65, 70-88, 90-92 or 94-99."""
    d = only_digits(c)
    mid = F.substr(d, F.lit(4), F.lit(2)).cast("int")
    return ((F.length(d) == 9) & F.substr(d, F.lit(1), F.lit(1)).eqNullSafe("9")
            & (mid.between(50, 65) | mid.between(70, 88) | mid.between(90, 92) | mid.between(94, 99)))


def ipv4_ok(c: Column) -> Column:
    """Every dotted octet <= 255."""
    parts = F.split(c, "\\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.cast("int") <= 255)
