"""Policy queries.

Two inputs: the ledger testbed (entities of completed files) and spans
detected in ``documents``.  Reports are flat rows (one per file or per
entity); the nested JSON form is a sink (``sources/reports.py``).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import masks as M
from ..functions import policy as P
from ..operators import classify as C
from ..operators import detect as D
from ..plans.testbed import Testbed
from ..sources.tables import read_table
from . import oracle as O
from .registry import register


def _fe(spark, sf, threshold=P.HIGH_CONFIDENCE_THRESHOLD):
    tb = Testbed(spark, sf)
    return C.ledger_entities(tb.files, tb.results, tb.entities, threshold)


def _counts(spark, sf):
    tb = Testbed(spark, sf)
    return C.ledger_type_counts(tb.files, tb.results, tb.entities)


def one_type():
    from pyspark.sql import types as T
    return T.StructType([T.StructField("entity_types", T.ArrayType(T.StringType())),
                         T.StructField("entity_count", T.LongType())])


def _joined(col):
    return F.array_join(col, ",")


# ---------------------------------------------------------------- documents
def _doc_sets(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    spans = D.detect_arrays(docs)
    # The type set comes straight from the span array of the same row: no
    # shuffle.  The non-empty test sits inside a generator (0 or 1 rows per
    # document), so Catalyst cannot push it below the detector and evaluate
    # the detector twice.
    types = F.array_sort(F.array_distinct(F.transform("entities", lambda s: s["entity_type"])))
    one = F.struct(types.alias("entity_types"), F.size("entities").cast("long").alias("entity_count"))
    rows = F.when(F.size("entities") > 0, F.array(one)).otherwise(F.array().cast(T.ArrayType(one_type())))
    return spans.select("doc_id", F.inline_outer(rows)).where(F.col("entity_types").isNotNull())


_DOC_SETS_SQL = ("SELECT doc_id, list_sort(list(DISTINCT entity_type)) AS types, count(*) AS entity_count "
                 "FROM spans GROUP BY doc_id")


@register("doc_tier", O.with_views(
    f"""SELECT doc_id, {O.sql_set_tier('types')} AS tier,
          {O.sql_pick(P.TIER_NAMES, O.sql_set_tier('types'))} AS tier_name,
          entity_count, array_to_string(types, ',') AS entity_types, {O.sql_label('types')} AS breach_label
        FROM ds""", extra=O.spans_view() + [("ds", _DOC_SETS_SQL)]))
def doc_tier(spark, sf):
    """Flagship: detect -> per-document type set -> tier and breach label.

    The set is built from the span array of the document row, so the whole
    query is a single narrow projection over the documents scan."""
    s = _doc_sets(spark, sf)
    t = F.col("entity_types")
    tier = P.set_tier(t)
    return s.select("doc_id", tier.alias("tier"), P.tier_name(tier).alias("tier_name"), "entity_count",
                    _joined(t).alias("entity_types"), P.breach_label(t).alias("breach_label"))


@register("doc_breach", O.with_views(
    f"""SELECT doc_id, entity_count, array_to_string(types, ',') AS entity_types, {O.sql_label('types')} AS classification,
          array_to_string({O.sql_reasons('types')}, ',') AS breach_reasons
        FROM ds WHERE {O.sql_trigger('types')}""", extra=O.spans_view() + [("ds", _DOC_SETS_SQL)]))
def doc_breach(spark, sf):
    """C4 over detected documents: documents that trigger notification."""
    s = C.with_breach(_doc_sets(spark, sf)).where("breach_trigger")
    return s.select("doc_id", "entity_count", _joined(F.col("entity_types")).alias("entity_types"),
                    "classification", _joined(F.col("breach_reasons")).alias("breach_reasons"))


# ---------------------------------------------------------------- ledger
@register("file_entity_sets", O.ledger_sql(
    "SELECT file_id, file_path, array_to_string(types, ',') AS entity_types, entity_count FROM fs"))
def file_entity_sets(spark, sf):
    """Entity type set and count per file (entities >= 0.7)."""
    s = C.entity_sets(_counts(spark, sf))
    return s.select("file_id", "file_path", _joined(F.col("entity_types")).alias("entity_types"), "entity_count")


@register("breach_trigger", O.ledger_sql(f"SELECT file_id, {O.sql_trigger('types')} AS breach_trigger FROM fs"))
def breach_trigger(spark, sf):
    """C1 per file."""
    s = C.entity_sets(_counts(spark, sf))
    return s.select("file_id", P.breach_trigger(F.col("entity_types")).alias("breach_trigger"))


@register("breach_label", O.ledger_sql(f"SELECT file_id, {O.sql_label('types')} AS classification FROM fs"))
def breach_label(spark, sf):
    """C2 per file (UNKNOWN when no component applies)."""
    s = C.entity_sets(_counts(spark, sf))
    return s.select("file_id", P.breach_label(F.col("entity_types")).alias("classification"))


@register("breach_reasons", O.ledger_sql(
    f"SELECT file_id, array_to_string({O.sql_reasons('types')}, ',') AS breach_reasons FROM fs"))
def breach_reasons(spark, sf):
    """C3 per file."""
    s = C.entity_sets(_counts(spark, sf))
    return s.select("file_id", _joined(P.breach_reasons(F.col("entity_types"))).alias("breach_reasons"))


@register("breach_files", O.ledger_sql(
    f"""SELECT file_id, file_path, entity_count, array_to_string(types, ',') AS entity_types,
          {O.sql_label('types')} AS classification FROM fs WHERE {O.sql_trigger('types')}"""))
def breach_files(spark, sf):
    """C4: triggering files with count, types and label."""
    b = C.breach_files(_counts(spark, sf))
    return b.select("file_id", "file_path", "entity_count", _joined(F.col("entity_types")).alias("entity_types"),
                    "classification")


@register("breach_report", O.ledger_sql(
    f"""SELECT fe.file_path, {O.sql_label('fs.types')} AS classification, fe.entity_type,
          {O.sql_display('fe.entity_type', P.STRICT_DISPLAY_NAMES)} AS category,
          {O.sql_mask_strict('fe.text', 'fe.entity_type')} AS masked_text, fe.score AS confidence
        FROM fe JOIN fs ON fe.file_id = fs.file_id WHERE {O.sql_trigger('fs.types')}"""))
def breach_report(spark, sf):
    """C5 (flat): every entity of every triggering file, masked (A9), with
    the file's label; the JSON record is this grouped by file and type."""
    fe = _fe(spark, sf)
    b = C.breach_files(_counts(spark, sf)).select("file_id", "classification")
    return fe.join(b, "file_id").select(
        "file_path", "classification", "entity_type",
        P.display_name(F.col("entity_type"), P.STRICT_DISPLAY_NAMES).alias("category"),
        M.mask_strict(F.col("text"), F.col("entity_type")).alias("masked_text"), F.col("score").alias("confidence"))


@register("classified_files", O.ledger_sql(
    f"""SELECT file_id, file_path, {O.sql_set_tier('types')} AS tier,
          {O.sql_pick(P.TIER_NAMES, O.sql_set_tier('types'))} AS tier_name, entity_count,
          array_to_string(types, ',') AS entity_types FROM fs"""))
def classified_files(spark, sf):
    """Tier per file."""
    c = C.classified_files(_counts(spark, sf))
    return c.select("file_id", "file_path", "tier", "tier_name", "entity_count",
                    _joined(F.col("entity_types")).alias("entity_types"))


@register("tier_min", O.ledger_sql(
    f"SELECT file_id, file_path, {O.sql_set_tier('types')} AS tier FROM fs WHERE {O.sql_set_tier('types')} >= 2"))
def tier_min(spark, sf):
    """Files at or above a minimum tier (2 = confidential)."""
    return C.classified_files(_counts(spark, sf), min_tier=2).select("file_id", "file_path", "tier")


@register("tier_report", O.ledger_sql(
    f"""SELECT fe.file_path, {O.sql_pick(P.TIER_KEYS, O.sql_set_tier('fs.types'))} AS classification,
          fe.entity_type, {O.sql_display('fe.entity_type', P.TIER_DISPLAY_NAMES)} AS category,
          {O.sql_mask_tiered('fe.text', 'fe.entity_type')} AS masked_text, fe.score AS confidence
        FROM fe JOIN fs ON fe.file_id = fs.file_id"""))
def tier_report(spark, sf):
    """C8 (flat): every entity with its file's tier key, masked (A10)."""
    fe = _fe(spark, sf)
    c = C.with_tier(C.entity_sets(_counts(spark, sf))).select("file_id", "classification")
    return fe.join(c, "file_id").select(
        "file_path", "classification", "entity_type",
        P.display_name(F.col("entity_type"), P.TIER_DISPLAY_NAMES).alias("category"),
        M.mask_tiered(F.col("text"), F.col("entity_type")).alias("masked_text"), F.col("score").alias("confidence"))


def _per_type_sql() -> str:
    return """(SELECT file_id, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS per_type
      FROM (SELECT file_id, entity_type, count(*) AS n FROM fe GROUP BY file_id, entity_type) x GROUP BY file_id)"""


def _per_type(fe):
    """Entity counts by type of each file, in one bounded string."""
    n = fe.groupBy("file_id", "entity_type").agg(F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat("entity_type", F.lit("="), F.col("n").cast("string"))))
    return n.groupBy("file_id").agg(F.array_join(pairs, ",").alias("per_type"))


@register("breach_records", O.ledger_sql(
    f"""SELECT file_path, entity_count, array_to_string(types, ',') AS entity_types, {O.sql_label('types')} AS classification,
          array_to_string({O.sql_reasons('types')}, ',') AS breach_reasons, per_type,
          count(*) OVER () AS file_count
        FROM fs JOIN {_per_type_sql()} p ON p.file_id = fs.file_id WHERE {O.sql_trigger('types')}"""))
def breach_records(spark, sf):
    """The record of each triggering file (its entities, masked and by
    type, are ``breach_report``'s rows)."""
    fe = _counts(spark, sf)
    b = C.breach_files(fe)
    return b.join(_per_type(fe), "file_id").select(
        "file_path", "entity_count", _joined(F.col("entity_types")).alias("entity_types"), "classification",
        F.array_join("breach_reasons", ",").alias("breach_reasons"), "per_type",
        b.agg(F.count(F.lit(1))).scalar().alias("file_count"))


@register("tier_records", O.ledger_sql(
    f"""SELECT file_path, {O.sql_pick(P.TIER_KEYS, O.sql_set_tier('types'))} AS classification,
          {O.sql_pick(P.TIER_NAMES, O.sql_set_tier('types'))} AS tier_name, entity_count,
          array_to_string(types, ',') AS entity_types, per_type, count(*) OVER () AS total_files,
          count(*) OVER (PARTITION BY {O.sql_set_tier('types')}) AS tier_files
        FROM fs JOIN {_per_type_sql()} p ON p.file_id = fs.file_id"""))
def tier_records(spark, sf):
    """The record of each classified file with the report's totals (its
    entities are ``tier_report``'s rows)."""
    fe = _counts(spark, sf)
    c = C.with_tier(C.entity_sets(fe))
    tiers = c.groupBy("tier").agg(F.count(F.lit(1)).alias("tier_files"))
    return c.join(_per_type(fe), "file_id").join(F.broadcast(tiers), "tier").select(
        "file_path", "classification", "tier_name", "entity_count", _joined(F.col("entity_types")).alias("entity_types"),
        "per_type", tiers.agg(F.sum("tier_files")).scalar().alias("total_files"), "tier_files")


@register("simple_highrisk", O.ledger_sql(
    f"""SELECT file_path, entity_type, {O.sql_display('entity_type', P.SIMPLE_CATEGORIES)} AS category,
          score AS confidence, {O.sql_mask_simple('text', 'entity_type')} AS masked_text
        FROM fe WHERE entity_type IN ({', '.join(O.q(t) for t in P.SIMPLE_CATEGORIES)})"""))
def simple_highrisk(spark, sf):
    """Policy-typed entities >= 0.7 with category and simple mask."""
    s = C.simple_highrisk(_fe(spark, sf))
    return s.select("file_path", "entity_type", "category", F.col("score").alias("confidence"),
                    F.col("masked").alias("masked_text"))


@register("policy_hits", O.ledger_sql(
    f"""SELECT file_id, array_to_string(list_sort(list_intersect(types, {O.lst(P.SENSITIVE_TYPES)})), ',') AS sensitive_hits,
          array_to_string(list_sort(list_intersect(types, {O.lst(P.RESTRICTED)})), ',') AS restricted_hits FROM fs"""))
def policy_hits(spark, sf):
    """Intersection of each file's set with the policy sets."""
    s = C.entity_sets(_counts(spark, sf))
    t = F.col("entity_types")
    return s.select("file_id",
                    _joined(F.array_sort(F.array_intersect(t, P._arr(P.SENSITIVE_TYPES)))).alias("sensitive_hits"),
                    _joined(F.array_sort(F.array_intersect(t, P._arr(P.RESTRICTED)))).alias("restricted_hits"))


@register("category_counts", O.ledger_sql(
    f"""SELECT file_path, {O.sql_display('entity_type', P.STRICT_DISPLAY_NAMES)} AS category, count(*) AS n
        FROM fe GROUP BY 1, 2"""))
def category_counts(spark, sf):
    """Entities per (file, category)."""
    return C.category_counts(_fe(spark, sf))


@register("breach_summary", O.ledger_sql(
    f"""SELECT 'label' AS kind, {O.sql_label('types')} AS name, count(*) AS files FROM fs
          WHERE {O.sql_trigger('types')} GROUP BY 2
        UNION ALL
        SELECT 'component' AS kind, c AS name, count(*) AS files
          FROM (SELECT unnest({O.sql_components('types')}) AS c FROM fs WHERE {O.sql_trigger('types')}) x GROUP BY 2"""))
def breach_summary(spark, sf):
    """Triggering files per label and per component."""
    return C.breach_summary(C.breach_files(_counts(spark, sf)))


@register("tier_summary", O.ledger_sql(
    f"""SELECT {O.sql_set_tier('types')} AS tier, {O.sql_pick(P.TIER_NAMES, O.sql_set_tier('types'))} AS tier_name,
          count(*) AS files FROM fs GROUP BY 1, 2"""))
def tier_summary(spark, sf):
    """Classified files per tier."""
    return C.tier_summary(C.classified_files(_counts(spark, sf)))


@register("tier_types", O.ledger_sql(
    f"""SELECT tier, array_to_string(list_sort(list(DISTINCT t)), ',') AS types FROM (
          SELECT {O.sql_set_tier('types')} AS tier, unnest(types) AS t FROM fs) x
        WHERE {O.sql_type_tier('t')} = tier GROUP BY tier"""))
def tier_types(spark, sf):
    """Union of a tier's own types over its files."""
    t = C.tier_types(C.classified_files(_counts(spark, sf)))
    return t.select("tier", _joined(F.col("types")).alias("types"))


@register("display_names", O.with_views(
    f"""SELECT entity_type, {O.sql_display('entity_type', P.TIER_DISPLAY_NAMES)} AS display_name,
          {O.sql_type_tier('entity_type')} AS tier, count(*) AS n FROM t_entities GROUP BY 1""", "t_entities"))
def display_names(spark, sf):
    """Dimension lookup with the key itself as default, per entity type."""
    e = Testbed(spark, sf).entities
    g = e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("entity_type", P.display_name(F.col("entity_type")).alias("display_name"),
                    P.type_tier(F.col("entity_type")).alias("tier"), "n")


def _mask_query(key, fn, sql_fn, doc):
    body = (f"SELECT file_id, start_index, entity_type, text, {sql_fn('text', 'entity_type')} AS masked "
            f"FROM t_entities")

    def build(spark, sf):
        e = Testbed(spark, sf).entities
        return e.select("file_id", "start_index", "entity_type", "text",
                        fn(F.col("text"), F.col("entity_type")).alias("masked"))
    build.__doc__ = doc
    register(key, O.with_views(body, "t_entities"))(build)


_mask_query("mask_strict", M.mask_strict, O.sql_mask_strict, "A9 over every entity row.")
_mask_query("mask_tiered", M.mask_tiered, O.sql_mask_tiered, "A10 over every entity row.")
_mask_query("mask_simple", M.mask_simple, O.sql_mask_simple, "A11 over every entity row.")


@register("join_ent_res_file", O.with_views(
    """SELECT f.file_path, e.entity_type, e.start_index, e.score FROM t_entities e
       JOIN t_results r ON e.result_id = r.result_id JOIN t_files f ON r.file_id = f.file_id
       WHERE f.job_id = 1""", "t_files", "t_results", "t_entities"))
def join_ent_res_file(spark, sf):
    """Entities ⨝ results ⨝ files (inner) for one job, any score."""
    tb = Testbed(spark, sf)
    e = C.ledger_entities(tb.files, tb.results, tb.entities, None, job_id=1, completed_only=False)
    return e.select("file_path", "entity_type", "start_index", "score")


@register("load_nested", O.ledger_sql(
    """SELECT file_path, count(*) AS n_entities, max(score) AS max_score,
         array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS entity_types FROM fe GROUP BY file_path"""))
def load_nested(spark, sf):
    """Completed files ⨝ results ⨝ entities (>= 0.7) as one set-based
    join (the reference's per-file lookups removed), nested per file."""
    from ..sources import reports as RP
    tb = Testbed(spark, sf)
    done = tb.files.where(F.col("status") == "completed")
    # nested per (file, salted part): a file's entity list is split, never
    # collected whole into one task; the per-file view merges the parts
    rec = RP.nested_records(tb.jobs, done, tb.results, tb.entities, threshold=0.7, mask=False)
    ex = rec.select("file_path", F.explode("entities").alias("e"))
    return ex.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_entities"), F.max("e.score").alias("max_score"),
        F.array_join(F.array_sort(F.collect_set("e.entity_type")), ",").alias("entity_types"))
