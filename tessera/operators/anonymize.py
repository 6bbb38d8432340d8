"""Redaction and anonymisation (A1-A8, D10 array form).

Spans stay an array on the document row, so redaction is a projection of
that row: sort -> merge overlaps into islands -> replace.  No join and no
shuffle between detection and redaction.  The output text is assembled as
``gap_0 + repl_0 + gap_1 + ... + tail`` with one ``array_join``, so the work
is linear in the number of islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import SPAN, scan

# fixed values: the operator names the reference accepts
METHODS = ("replace", "redact", "mask", "hash", "encrypt")

ISLAND = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("n_spans", T.IntegerType()),
])


def validate(method: str, operators: dict | None = None, key: str | None = None) -> None:
    """Unknown methods (and encrypt without a key) fail before any job runs."""
    from ..functions.plugins import CUSTOM_OPERATORS
    for m in [method, *((operators or {}).values())]:
        if m not in METHODS and m not in CUSTOM_OPERATORS:
            raise ValueError(f"Invalid anonymization method: {m}. Must be one of {list(METHODS)}")
        if m == "encrypt" and not key:
            raise ValueError("encrypt needs a key of 16, 24 or 32 bytes")


def _better(a: Column, b: Column) -> Column:
    """True when span ``a`` should label an island over ``b``: higher score,
    then longer, then earlier, then type name (order-independent)."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    return ((a["score"] > b["score"])
            | ((a["score"] == b["score"]) & (la > lb))
            | ((a["score"] == b["score"]) & (la == lb) & (a["start"] < b["start"]))
            | ((a["score"] == b["score"]) & (la == lb) & (a["start"] == b["start"])
               & (a["entity_type"] > b["entity_type"])))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def islands(spans: Column) -> Column:
    """D10 (array form): merge overlapping spans; one labelled island each.

    Spans are sorted by start; a span opens a new island when it starts at
    or after the largest end before it (a scan).  An island is a slice of the
    sorted spans, so the work follows the number of spans."""
    srt = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                       .when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1)
                       .when(a["entity_type"] < b["entity_type"], -1)
                       .when(a["entity_type"] > b["entity_type"], 1).otherwise(0))

    def merged(group):
        best = F.aggregate(group, F.get(group, F.lit(0)), lambda x, s: F.when(_better(s, x), s).otherwise(x))
        return F.struct(best["entity_type"].alias("entity_type"), F.get(group, F.lit(0))["start"].alias("start"),
                        F.array_max(F.transform(group, lambda s: s["end"])).alias("end"),
                        best["score"].alias("score"), F.size(group).alias("n_spans"))

    def cut(s, opens):
        return F.transform(opens, lambda o, k: merged(F.slice(
            s, o + 1, F.coalesce(F.get(opens, k + 1), F.size(s)) - o)))

    def split(s):
        reach = scan(F.transform(s, lambda x: x["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        flags = F.zip_with(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"))), reach,
                           lambda x, r: F.when(x["start"] >= r, x["i"]))
        return _bound(F.filter(flags, lambda i: i.isNotNull()), lambda opens: cut(s, opens))
    return _bound(srt, split)


def replacement(method: str, span_text: Column, etype: Column, key: str | None = None) -> Column:
    if method == "replace":
        return F.concat(F.lit("<"), etype, F.lit(">"))
    if method == "redact":
        return F.lit("")
    if method == "mask":
        return F.repeat(F.lit("*"), F.length(span_text))
    if method == "hash":
        return F.sha2(span_text, 256)
    if method == "encrypt":
        return F.base64(F.aes_encrypt(span_text, F.lit(key), F.lit("ECB")))
    from ..functions.plugins import CUSTOM_OPERATORS
    if method in CUSTOM_OPERATORS:
        return CUSTOM_OPERATORS[method](span_text, etype)
    raise ValueError(method)


def _repl(text: Column, isl: Column, method: str, operators: dict | None, key: str | None) -> Column:
    span_text = F.substr(text, isl["start"] + 1, isl["end"] - isl["start"])
    out = replacement(method, span_text, isl["entity_type"], key)
    for etype, m in sorted((operators or {}).items()):
        out = F.when(isl["entity_type"] == etype, replacement(m, span_text, isl["entity_type"], key)).otherwise(out)
    return out


def _op_name(etype: Column, method: str, operators: dict | None) -> Column:
    out = F.lit(method)
    for k, m in sorted((operators or {}).items()):
        out = F.when(etype == k, F.lit(m)).otherwise(out)
    return out


def with_islands(df: DataFrame, spans_col: str = "entities", out_col: str = "_isl") -> DataFrame:
    """Stage the islands as their own column so later expressions read it
    instead of re-evaluating the sort and fold."""
    return df.withColumn(out_col, islands(F.col(spans_col)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "entities", method: str = "replace",
           operators: dict | None = None, key: str | None = None, out_col: str = "redacted",
           keep_islands: bool = False) -> DataFrame:
    """The text with every island replaced by its operator; empty
    text or no spans leave the text unchanged (P14).  Staged columns:
    islands -> previous island ends -> pieces, each computed once per row."""
    validate(method, operators, key)
    t = F.col(text_col)
    d = with_islands(df, spans_col)
    isl = F.col("_isl")
    d = d.withColumn("_prev", F.concat(F.array(F.lit(0)), F.slice(F.transform(isl, lambda x: x["end"]), 1,
                                                                  F.greatest(F.size(isl) - 1, F.lit(0)))))
    pieces = F.zip_with(isl, F.col("_prev"), lambda x, p: F.concat(
        F.substr(t, p + 1, x["start"] - p), _repl(t, x, method, operators, key)))
    last_end = F.coalesce(F.element_at(isl, -1)["end"], F.lit(0))
    tail = F.substr(t, last_end + 1, F.greatest(F.length(t) - last_end, F.lit(0)))
    out = F.when((F.size(isl) == 0) | t.isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), tail))
    d = d.withColumn(out_col, out).drop("_prev")
    return d if keep_islands else d.drop("_isl")


def audit(df: DataFrame, text_col: str = "text", spans_col: str = "entities", method: str = "replace",
          operators: dict | None = None, key: str | None = None, id_cols=("doc_id",)) -> DataFrame:
    """One row per island with old and new offsets.  Q11: new offsets
    shift by the length change of every earlier island (a running sum over
    the document's own array, so no shuffle)."""
    validate(method, operators, key)
    t = F.col(text_col)
    d = with_islands(df, spans_col)
    d = d.withColumn("_new", F.transform("_isl", lambda x: _repl(t, x, method, operators, key)))
    d = d.withColumn("_delta", F.zip_with("_isl", "_new", lambda x, n: F.length(n) - (x["end"] - x["start"])))
    d = d.withColumn("_shift", scan(F.col("_delta"), F.lit(0), lambda a, b: a + b))
    d = d.withColumn("_orig", F.transform("_isl", lambda x: F.substr(t, x["start"] + 1, x["end"] - x["start"])))
    z = F.arrays_zip(F.col("_isl").alias("isl"), F.col("_new").alias("new"), F.col("_shift").alias("shift"),
                     F.col("_orig").alias("orig"))
    ex = d.select(*id_cols, F.posexplode_outer(z).alias("pos", "z")).where(F.col("z").isNotNull())
    x = F.col("z.isl")
    return ex.select(*id_cols, "pos", x["entity_type"].alias("entity_type"), x["start"].alias("start"),
                     x["end"].alias("end"), (x["start"] + F.col("z.shift")).alias("new_start"),
                     (x["start"] + F.col("z.shift") + F.length("z.new")).alias("new_end"),
                     F.col("z.orig").alias("original"),
                     F.col("z.new").alias("replacement"),
                     _op_name(x["entity_type"], method, operators).alias("operator"))


def redact_batch(docs: DataFrame, span_lists: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                 method: str = "replace") -> DataFrame:
    """Texts and separately computed span lists, matched by key (a
    positional mismatch cannot happen); a text without a list is unchanged."""
    j = docs.join(span_lists, list(id_cols), "left")
    j = j.withColumn("entities", F.coalesce(F.col("entities"), F.array().cast(T.ArrayType(SPAN))))
    return redact(j, text_col, "entities", method)


def redaction_record(df: DataFrame, text_col: str, redacted_col: str, spans_col: str, method: str) -> DataFrame:
    """The JSON record of a redacted file: lengths, count, method, text."""
    return df.select(F.length(text_col).alias("original_length"), F.length(redacted_col).alias("redacted_length"),
                     F.size(spans_col).alias("entities_redacted"),
                     F.lit(method).alias("redaction_method"), F.col(redacted_col).alias("redacted_text"))


def scan_texts(docs: DataFrame, settings, id_cols=("doc_id",), text_col: str = "text", key: str | None = None) -> DataFrame:
    """Detection and redaction under one ``ScanSettings``: texts above
    ``max_file_bytes`` are left out, spans below the threshold or of other
    types do not count, operators go by type."""
    from .detect import DEFAULT_THRESHOLD, detect_arrays
    small = docs.where(F.octet_length(text_col) <= settings.max_file_bytes)
    spans = detect_arrays(small.select(*id_cols, text_col), text_col, (*id_cols, text_col), settings.entities,
                          settings.effective_threshold(DEFAULT_THRESHOLD))
    out = redact(spans, text_col, "entities", settings.method, settings.operators, key)
    return out.select(*id_cols, F.size("entities").alias("entity_count"), "redacted")


def scan_files(files: DataFrame, settings, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """A scan of files under all of one ``ScanSettings``: its extensions
    and size limit choose the files, its threshold and types the spans, and
    ``min_tier`` the files that are reported: ``(path, entity_count, tier)``."""
    from ..functions import policy as P
    from .detect import DEFAULT_THRESHOLD, spans_column, spread
    from .ledger import is_supported
    path = F.col(path_col)
    chosen = files.where(F.octet_length(text_col) <= settings.max_file_bytes)
    if settings.extensions is not None:
        chosen = chosen.where(is_supported(path, settings.extensions))
    spans = spans_column(text_col, settings.entities, settings.effective_threshold(DEFAULT_THRESHOLD))
    found = spread(chosen, (path_col,)).select(path_col, spans.alias("_s"))
    types = F.array_distinct(F.transform("_s", lambda s: s["entity_type"]))
    # a generator of one row: the tier's filter cannot be pushed below the detector and run it again
    one = found.select(path_col, F.inline_outer(F.array(F.struct(types.alias("_types"), F.size("_s").alias("entity_count")))))
    tier = F.when(F.col("entity_count") > 0, P.set_tier(F.col("_types"))).otherwise(F.lit(0))
    return one.select(path_col, "entity_count", tier.cast("int").alias("tier")).where(F.col("tier") >= settings.min_tier)
