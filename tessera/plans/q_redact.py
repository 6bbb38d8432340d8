"""Redaction queries (A1-A8, S11) and span overlap handling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import anonymize as A
from ..operators import detect as D
from ..session import scratch_path
from ..sources import files as FS
from ..sources import sinks as SK
from ..sources.tables import read_table
from . import oracle as O
from .registry import register
from .testbed import Testbed


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _with_spans(spark, sf):
    docs = _docs(spark, sf)
    return D.spread(docs).select("doc_id", "text", D.spans_column("text").alias("entities"))


# ---------------------------------------------------------------- SQL twins
_ENT_SPANS = """SELECT file_id, entity_type, start_index AS start, end_index AS "end", score FROM t_entities"""


def _islands_sql(src: str, key: str) -> list[tuple[str, str]]:
    order = f'PARTITION BY {key} ORDER BY start, "end", entity_type'
    return [
        ("im", f"""SELECT *, max("end") OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
                   FROM {src}"""),
        ("ig", f"""SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END)
                     OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS island FROM im"""),
        ("isl", f"""SELECT {key}, island, min(start) AS start, max("end") AS "end",
                      max(struct_pack(s := score, l := "end" - start, n := -start, t := entity_type)) AS b,
                      count(*) AS n_spans
                    FROM ig GROUP BY {key}, island"""),
    ]


def _repl_sql(method: str, ops: dict | None = None) -> str:
    span = 'substr(d.text, i.start + 1, i."end" - i.start)'

    def one(m):
        return {"replace": "'<' || i.b.t || '>'", "redact": "''",
                "mask": "repeat('*', length(" + span + "))", "hash": "sha256(" + span + ")"}[m]
    out = one(method)
    for k, m in sorted((ops or {}).items()):
        out = f"CASE WHEN i.b.t = {O.q(k)} THEN {one(m)} ELSE {out} END"
    return out


def _redact_sql(method: str, ops: dict | None = None) -> str:
    ctes = O.spans_view(None, 0.7) + _islands_sql("spans", "doc_id") + [
        ("pc", """SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM isl"""),
        ("red", f"""SELECT i.doc_id, string_agg(substr(d.text, i.prev + 1, i.start - i.prev) || {_repl_sql(method, ops)}, ''
                      ORDER BY i.start) || substr(d.text, max(i."end") + 1) AS redacted
                    FROM pc i JOIN documents d ON i.doc_id = d.doc_id GROUP BY i.doc_id, d.text""")]
    return O.with_views("""SELECT d.doc_id, coalesce(r.redacted, d.text) AS redacted
                           FROM documents d LEFT JOIN red r ON d.doc_id = r.doc_id""", extra=ctes)


# ---------------------------------------------------------------- queries
@register("span_islands", O.with_views(
    'SELECT file_id, island, b.t AS entity_type, start, "end", b.s AS score, n_spans FROM isl',
    "t_entities", extra=[("es", _ENT_SPANS)] + _islands_sql("es", "file_id")))
def span_islands(spark, sf):
    """D10 (long form): overlapping spans of a file merged into islands."""
    e = Testbed(spark, sf).entities.select("file_id", "entity_type", F.col("start_index").alias("start"),
                                           F.col("end_index").alias("end"), "score")
    return D.span_islands(e, ("file_id",))


@register("span_overlaps", O.with_views(
    """SELECT a.file_id, a.entity_type AS a_entity_type, a.start AS a_start, a."end" AS a_end,
         b.entity_type AS b_entity_type, b.start AS b_start, b."end" AS b_end
       FROM es a JOIN es b ON a.file_id = b.file_id AND a.start < b."end" AND b.start < a."end"
         AND a.entity_type < b.entity_type""", "t_entities", extra=[("es", _ENT_SPANS)]))
def span_overlaps(spark, sf):
    """Overlapping span pairs of different type (bucketed range join)."""
    e = Testbed(spark, sf).entities.select("file_id", "entity_type", F.col("start_index").alias("start"),
                                           F.col("end_index").alias("end"))
    return D.span_overlaps(e, ("file_id",))


def _redact_query(key, method, ops=None, doc=""):
    def build(spark, sf):
        return A.redact(_with_spans(spark, sf), method=method, operators=ops).select("doc_id", "redacted")
    build.__doc__ = doc
    register(key, _redact_sql(method, ops))(build)


_redact_query("redact_replace", "replace", doc="A1: every island replaced by <TYPE>.")
_redact_query("redact_remove", "redact", doc="A2: every island removed.")
_redact_query("redact_mask", "mask", doc="A3: every island masked with one '*' per character.")
_redact_query("redact_hash", "hash", doc="A4: every island replaced by its SHA-256 hex.")
_redact_query("redact_by_type", "replace", {"EMAIL_ADDRESS": "mask", "ACCESS_CODE": "hash"},
              doc="A6: per-type operators (e-mail masked, access codes hashed), replace for the rest.")


# the key is a parameter of the operators; a fixed one makes the query reproducible
KEY = "0123456789abcdef"


@register("redact_encrypt")
def redact_encrypt(spark, sf):
    """A5: deterministic AES (ECB) + base64 of each island; needs a key."""
    return A.redact(_with_spans(spark, sf), method="encrypt", key=KEY).select("doc_id", "redacted")


@register("redact_encrypt_audit", O.with_views(
    """SELECT i.doc_id, i.b.t AS entity_type, i.start, i."end", substr(d.text, i.start + 1, i."end" - i.start) AS original,
         CAST(4 * ((16 * (strlen(substr(d.text, i.start + 1, i."end" - i.start)) // 16 + 1) + 2) // 3) AS INT) AS cipher_chars
       FROM isl i JOIN documents d ON i.doc_id = d.doc_id""",
    extra=O.spans_view(None, 0.7) + _islands_sql("spans", "doc_id")))
def redact_encrypt_audit(spark, sf, key: str = KEY):
    """A5 by round trip: each encrypted island decrypted again, and the
    length of its padded cipher text."""
    a = A.audit(_with_spans(spark, sf), method="encrypt", key=key)
    plain = F.aes_decrypt(F.unbase64("replacement"), F.lit(key), F.lit("ECB")).cast("string")
    return a.select("doc_id", "entity_type", "start", "end", plain.alias("original"),
                    F.length("replacement").alias("cipher_chars"))


@register("redact_audit", O.with_views(
    f"""SELECT doc_id, CAST(pos AS INT) AS pos, entity_type, start, "end", start + shift AS new_start,
          CAST(start + shift + length(replacement) AS INT) AS new_end, original, replacement, 'replace' AS operator
        FROM (SELECT i.doc_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY i.start) - 1 AS pos, i.b.t AS entity_type,
                i.start, i."end", substr(d.text, i.start + 1, i."end" - i.start) AS original,
                '<' || i.b.t || '>' AS replacement,
                CAST(coalesce(sum(length('<' || i.b.t || '>') - (i."end" - i.start)) OVER (PARTITION BY i.doc_id
                  ORDER BY i.start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS shift
              FROM isl i JOIN documents d ON i.doc_id = d.doc_id) x""",
    extra=O.spans_view(None, 0.7) + _islands_sql("spans", "doc_id")))
def redact_audit(spark, sf):
    """Audit rows with old and new offsets, old and new text."""
    return A.audit(_with_spans(spark, sf))


@register("redact_batch", _redact_sql("replace"))
def redact_batch(spark, sf):
    """Span lists computed separately and matched to texts by key."""
    docs = _docs(spark, sf)
    lists = D.detect_arrays(docs)
    return A.redact_batch(docs, lists).select("doc_id", "redacted")


_RED = O.spans_view(None, 0.7) + _islands_sql("spans", "doc_id") + [
        ("pc", """SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM isl"""),
        ("red", f"""SELECT i.doc_id, string_agg(substr(d.text, i.prev + 1, i.start - i.prev) || '<' || i.b.t || '>', ''
                      ORDER BY i.start) || substr(d.text, max(i."end") + 1) AS redacted
                    FROM pc i JOIN documents d ON i.doc_id = d.doc_id GROUP BY i.doc_id, d.text""")]


@register("redact_record", O.with_views(
    """SELECT CAST(length(d.text) AS INT) AS original_length, CAST(length(r.redacted) AS INT) AS redacted_length,
         CAST(c.n AS INT) AS entities_redacted, 'replace' AS redaction_method, r.redacted AS redacted_text
       FROM documents d JOIN red r ON d.doc_id = r.doc_id
       JOIN (SELECT doc_id, count(*) AS n FROM isl GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
    extra=_RED))
def redact_record(spark, sf):
    """JSON-ready record per redacted document (lengths, island count,
    method, text) for documents with at least one entity."""
    d = A.redact(_with_spans(spark, sf), keep_islands=True)
    d = d.where(F.size("_isl") > 0)
    return A.redaction_record(d, "text", "redacted", "_isl", "replace")


_DOC_PATH = "concat('/corpus/a+b (c)/', {d}lang, '/', coalesce({d}source, 'none'), '/', CAST({d}doc_id AS {text}), '.txt')"


@register("redact_files", O.with_views(
    f"""SELECT path, redacted AS content, file_path, original_text_length, anonymized_text_length, entities_redacted, anonymize_method
       FROM (SELECT substr({_DOC_PATH.format(d='d.', text='VARCHAR')}, length('/corpus/a+b (c)/') + 1) AS path, r.redacted,
               substr({_DOC_PATH.format(d='d.', text='VARCHAR')}, length('/corpus/a+b (c)/') + 1) AS file_path,
               CAST(length(d.text) AS INT) AS original_text_length, CAST(length(r.redacted) AS INT) AS anonymized_text_length,
               CAST(c.n AS INT) AS entities_redacted, 'replace' AS anonymize_method
             FROM documents d JOIN red r ON d.doc_id = r.doc_id
             JOIN (SELECT doc_id, count(*) AS n FROM isl GROUP BY doc_id) c ON d.doc_id = c.doc_id) x""", extra=_RED))
def redact_files(spark, sf):
    """Every redacted document written to its own relative path, as a
    text file and as a JSON record, and both read back."""
    d = A.redact(D.detect_arrays(read_table(spark, sf, "documents").withColumn("path", F.expr(_DOC_PATH.format(d="", text="STRING"))),
                                 id_cols=("path", "text")), keep_islands=True)
    d = d.withColumn("path", F.substr(SK.relative_output(F.col("path"), "/corpus/a+b (c)", "/o"), F.lit(4)))
    texts, records = (scratch_path(spark, f"tessera-redacted-{uuid.uuid4().hex[:12]}") for _ in range(2))
    FS.write_redacted(d, texts, "path")
    FS.write_redacted(d, records, "path", as_json=True)
    schema = "file_path string, original_text_length int, anonymized_text_length int, entities_redacted int, anonymize_method string"
    back = FS.read_files(spark, records).select("path", F.from_json("content", schema).alias("r"))
    return FS.read_files(spark, texts).join(back, "path").select("path", "content", "r.*")


@register("scan_settings", O.with_views(
    f"""SELECT d.doc_id, CAST((SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS INT) AS entity_count, r.redacted
        FROM documents d JOIN ({_redact_sql('mask', {'EMAIL_ADDRESS': 'replace'})}) r ON r.doc_id = d.doc_id
        WHERE strlen(d.text) <= 10000""", extra=O.spans_view(None, 0.7)))
def scan_settings(spark, sf):
    """A scan under one settings object (size gate, threshold, default
    and per-type operators)."""
    from ..functions.plugins import ScanSettings
    settings = ScanSettings(threshold=None, method="mask", operators={"EMAIL_ADDRESS": "replace"}, max_file_bytes=10_000)
    return A.scan_texts(_docs(spark, sf), settings)
