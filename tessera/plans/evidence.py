"""A text for each order that holds, or nearly holds, a value of one type.

Written in SQL that Spark and DuckDB read alike: digits come from the order
and customer keys, so checksums hold for some rows and fail for others; some
texts have a cue word and some have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read_table

K, C = "o_orderkey", "o_custkey"
D9 = f"lpad(concat('', ({K} * 7919 + {C} * 104729) % 1000000000), 9, '0')"
D16 = f"concat({D9}, lpad(concat('', ({K} * 31337 + {C} * 17) % 10000000), 7, '0'))"


def _d(first: int, n: int, of: str = D9) -> str:
    return f"substr({of}, {first}, {n})"


TEXTS = (
    f"'ssn ', {_d(1, 3)}, '-', {_d(4, 2)}, '-', {_d(6, 4)}",
    f"'on file 9', {_d(1, 2)}, '-', {_d(3, 2)}, '-', {_d(5, 4)}, ' itin'",
    f"'host ', {K} % 300, '.', {C} % 260, '.', {K} % 7, '.', {C} % 256",
    f"'card 4', {_d(2, 15, D16)}, ' on file'",
    f"'x ', {_d(1, 4, D16)}, '-', {_d(5, 4, D16)}, '-', {_d(9, 4, D16)}, '-', {_d(13, 4, D16)}",
    f"'routing ', {D9}",
    f"'some number ', {D9}, ' without a cue'",
    f"'nhs ', {D9}, {K} % 10",
    f"'tfn ', {D9}",
    f"'medicare 2', {D9}",
    f"'zip ', {_d(1, 5)}, ' and ', {_d(5, 5)}, '-', {_d(1, 4)}",
    f"'iban account GB', {_d(1, 2)}, 'WEST', {_d(1, 14, D16)}",
    f"'account DE', {_d(1, 2)}, {_d(1, 16, D16)}, {_d(1, 2)}",
    f"'aws key AKIAQ7', {_d(1, 14, D16)}, ' or AKIA', {_d(1, 3)}",
    f"'mail user', {K}, '@host', {C} % 9, '.example.com; not user', {K}, '@host'",
    f"'phone 555-', {_d(1, 3)}, '-', {_d(4, 4)}, ' or (919) 555-', {_d(1, 4)}",
    f"'home: ', {K} % 9000, ' Long Oak Street, ', {C}, ' oak street'",
    f"'access code: tok', {D9}, ' token = a1'",
    f"'password: p', {D9}, '!'", f"'pin: ', {_d(1, 3)}, ' PIN code # ', {_d(1, 6)}",
    f"'username: user.', {K}, ' user id=u'", f"'security answer: blue car ', {K}",
    "'name: John Smith; full name: jane'", "'donor name: Jane Ann Roe'", f"'driver license: D', {D9}",
    f"'passport # P', {D9}", f"'mrn: M', {D9}", f"'insurance policy number: H', {D9}", f"'medical license: L', {D9}",
    f"'student id: S', {D9}", f"'employee id = E', {D9}", f"'gov id: G', {D9}", f"'grant # R', {D9}",
    f"'bank account: ', {D9}", f"'checking # ', {D9}", f"'swift: ABCDEF', {K} % 10, 'X'",
    "'a digital  signature and digital-signatures'", "'fingerprint, Iris scan, voiceprints'",
    "'ITAR rules: export controlled'", "' '",
)

ROW = (f"SELECT -1 - {K} AS doc_id, CASE {K} % {len(TEXTS)} "
       + " ".join(f"WHEN {i} THEN concat({t}, '')" for i, t in enumerate(TEXTS)) + " END AS text")
#: DuckDB: the documents and the evidence texts
CORPUS_SQL = f"SELECT doc_id, text FROM documents UNION ALL {ROW} FROM orders"


def corpus(spark, sf: str) -> DataFrame:
    """doc_id, text of the documents and, with negative ids, the orders."""
    text = ROW.split("AS doc_id, ", 1)[1].removesuffix(" AS text")
    own = read_table(spark, sf, "orders").select((F.lit(-1) - F.col(K)).alias("doc_id"), F.expr(text).alias("text"))
    return read_table(spark, sf, "documents").select("doc_id", "text").union(own)
