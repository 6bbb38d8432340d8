"""Report masks (A9 strict, A10 tiered, A11 simple) as column expressions.

Lengths are code points, like Python ``len``; "words" are runs of
non-whitespace, like ``str.split()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import policy as P

NAME_TYPES = ["PERSON", "FIRST_NAME", "LAST_NAME"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+", -1), lambda w: w != "")


def _first(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.lit(1))


def _last(text: Column, n: int = 1) -> Column:
    return F.substr(text, F.length(text) - n + 1, F.lit(n))


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def _user(text: Column) -> Column:
    return F.substring_index(text, "@", 1)


def _domain(text: Column) -> Column:
    return F.substr(text, F.instr(text, "@") + 1, F.length(text))


def mask_strict(text: Column, etype: Column) -> Column:
    """Last four for sensitive types; first char of e-mail users;
    initials for names; first and last character otherwise."""
    n = F.length(text)
    words = _words(text)
    sensitive = F.when(n > 4, F.concat(F.lit("****"), _last(text, 4))).otherwise(F.lit("****"))
    user = _user(text)
    login = (F.when(F.instr(text, "@") > 0,
                    F.when(F.length(user) > 2, F.concat(_first(user), F.lit("***@"), _domain(text)))
                    .otherwise(F.concat(F.lit("***@"), _domain(text))))
             .when(n > 4, F.concat(_first(text), F.lit("***"), _last(text)))
             .otherwise(F.lit("****")))
    name = (F.when(F.size(words) > 1,
                   F.array_join(F.transform(words, lambda w: F.concat(_first(w), F.lit("."))), " "))
            .when(n > 0, F.concat(_first(text), F.lit(".")))
            .otherwise(F.lit("****")))
    other = F.when(n > 4, F.concat(_first(text), F.lit("***"), _last(text))).otherwise(F.lit("****"))
    return (F.when(etype.isin(*P.SENSITIVE_TYPES), sensitive)
            .when(etype.isin("EMAIL_ADDRESS", "USERNAME"), login)
            .when(etype.isin(*NAME_TYPES), name)
            .otherwise(other))


def mask_tiered(text: Column, etype: Column) -> Column:
    """A10: eight stars for top secrets; star-padded names and ids (last four
    kept); e-mail user keeps first and last; first/last kept otherwise."""
    n = F.length(text)
    words = _words(text)
    one_name = F.when(n <= 2, F.concat(_first(text), F.lit("*"))).otherwise(
        F.concat(_first(text), _stars(n - 1)))
    many = F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 1, w).otherwise(
        F.concat(_first(w), _stars(F.length(w) - 1)))), " ")
    name = F.when(F.size(words) == 1, one_name).otherwise(many)
    last4 = F.when(n <= 4, _stars(n)).otherwise(F.concat(_stars(n - 4), _last(text, 4)))
    user = _user(text)
    ulen = F.length(user)
    masked_user = F.when(ulen <= 2, user).otherwise(F.concat(_first(user), _stars(ulen - 2), _last(user)))
    email = F.concat(masked_user, F.lit("@"), _domain(text))
    other = F.when(n <= 2, text).otherwise(F.concat(_first(text), _stars(n - 2), _last(text)))
    return (F.when(text.isNull() | (n == 0), F.lit(""))
            .when(etype.isin(*P.TIER_FULL_MASK), F.lit("********"))
            .when(etype.isin(*NAME_TYPES), name)
            .when(etype.isin(*P.TIER_LAST4_MASK), last4)
            .when((etype == "EMAIL_ADDRESS") & (F.instr(text, "@") > 0), email)
            .otherwise(other))


def mask_simple(text: Column, etype: Column) -> Column:
    """Last four for account numbers; two chars of e-mail users; phone
    last four digits; 'J. Last' for names; first/last otherwise."""
    n = F.length(text)
    words = _words(text)
    last4 = F.when(n > 4, F.concat(F.lit("****"), _last(text, 4))).otherwise(F.lit("****"))
    at_parts = F.split(text, "@", -1)
    user = at_parts[0]
    email = F.when(F.size(at_parts) == 2, F.when(F.length(user) > 2, F.concat(
        F.substr(user, F.lit(1), F.lit(2)), F.lit("***@"), at_parts[1])).otherwise(
        F.concat(F.lit("***@"), at_parts[1]))).otherwise(F.lit("***@***"))
    digits = F.regexp_replace(text, "[^0-9]", "")
    phone = F.when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), _last(digits, 4))).otherwise(
        F.lit("***-***-****"))
    name = F.when(F.size(words) > 1, F.concat(_first(words[0]), F.lit(". "), F.element_at(words, -1))).otherwise(text)
    other = F.when(n > 4, F.concat(_first(text), F.lit("***"), _last(text))).otherwise(F.lit("****"))
    return (F.when(etype.isin(*P.SIMPLE_LAST4_MASK), last4)
            .when(etype == "EMAIL_ADDRESS", email)
            .when(etype == "PHONE_NUMBER", phone)
            .when(etype == "PERSON", name)
            .otherwise(other))
