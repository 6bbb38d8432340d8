"""String helpers that both the operators and their SQL need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that strip() removes in the reference's language.
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
         "    　")


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.btrim(text, F.lit(SPACE))


def strip_sql(text: str) -> str:
    """DuckDB twin of ``strip``."""
    return f"trim({text}, '{SPACE}')"
