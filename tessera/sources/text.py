"""Text sources (S5, S6): extracted text rows and markup-to-text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import strip

# fixed values: the named character entities decoded by html_to_text (& last)
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&hellip;", "\u2026"),
            ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"),
            ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&bull;", "\u2022"), ("&copy;", "\u00a9"),
            ("&reg;", "\u00ae"), ("&trade;", "\u2122"), ("&deg;", "\u00b0"), ("&euro;", "\u20ac"),
            ("&pound;", "\u00a3"), ("&sect;", "\u00a7"), ("&laquo;", "\u00ab"), ("&raquo;", "\u00bb"),
            ("&amp;", "&")]
NUMERIC = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal character references as characters; those that
    name no character stay."""
    def char(ref):
        body = F.substring_index(ref, ";", 1)
        hexa = F.lower(F.substr(body, F.lit(3), F.lit(1))) == "x"
        code = F.when(hexa, F.conv(F.substr(body, F.lit(4)), 16, 10)).otherwise(F.substr(body, F.lit(3))).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)
    gaps = F.split(text, NUMERIC, -1)
    refs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), 0), char), F.array(F.lit("")))
    return F.when(text.contains("&#"), F.array_join(F.zip_with(gaps, refs, lambda g, r: F.concat(g, r)), "")).otherwise(text)


def text_rows(df: DataFrame, text_col: str = "text", id_cols=("doc_id",)) -> DataFrame:
    """Trimmed text per row, blank rows dropped (the reference's
    extractor contract: empty text means nothing to analyse)."""
    return df.select(*id_cols, strip(F.col(text_col)).alias(text_col)).where(F.length(text_col) > 0)


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole text files as (path, text) rows, one row per file."""
    r = spark.read.option("wholetext", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def html_to_text(html: Column) -> Column:
    """Drop script/style/comments, turn block tags into line breaks,
    strip the remaining tags, decode common entities, squeeze spaces."""
    t = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, "(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    t = _numeric_entities(t)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.regexp_replace(t, "[ \t\r\f]+", " ")
    t = F.regexp_replace(t, " *\n[ \n]*", "\n")
    return F.regexp_replace(t, "^[ \n]+|[ \n]+$", "")
