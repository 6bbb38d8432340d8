"""Policy classification.

Shape of every policy job: threshold filter -> one partially-aggregated
``collect_set`` per file (the set is bounded by the type vocabulary, so a
file with a third of all entities still ships at most one small set per map
task) -> set rules as column expressions.  Entity-level report rows are
joined back on the file key instead of being collected into lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import policy as P


def ledger_entities(files: DataFrame, results: DataFrame, entities: DataFrame,
                    threshold: float | None = P.HIGH_CONFIDENCE_THRESHOLD, job_id=None,
                    completed_only: bool = True, columns: tuple = ()) -> DataFrame:
    """Entities ⨝ results ⨝ files in one set-based plan (no N+1).

    Results and files are joined first (one row per file each), so the large
    entity side is shuffled once, on ``result_id``; AQE splits a hot file.
    Q6: one result per file — the lowest ``result_id``.
    """
    f = files
    if completed_only:
        f = f.where(F.col("status") == "completed")
    if job_id is not None:
        f = f.where(F.col("job_id") == job_id)
    first_result = results.groupBy("file_id").agg(F.min("result_id").alias("result_id"))
    rf = first_result.join(f.select("file_id", "job_id", "file_path", "file_type"), "file_id")
    e = entities.select("result_id", "entity_type", "start_index", "end_index", "score", "text", *columns)
    if threshold is not None:
        e = e.where(F.col("score") >= F.lit(float(threshold)))
    return e.join(rf, "result_id")


def ledger_type_counts(files: DataFrame, results: DataFrame, entities: DataFrame, **options) -> DataFrame:
    """:func:`ledger_entities` by (file, type) with the count ``n``: the
    entities are reduced to one row per result and type before the join."""
    threshold = options.pop("threshold", P.HIGH_CONFIDENCE_THRESHOLD)
    e = entities if threshold is None else entities.where(F.col("score") >= F.lit(float(threshold)))
    few = e.groupBy("result_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    few = few.select("result_id", "entity_type", *(F.lit(None).alias(c) for c in ("start_index", "end_index", "score", "text")), "n")
    return ledger_entities(files, results, few, threshold=None, columns=("n",), **options).select(
        "file_id", "job_id", "file_path", "file_type", "result_id", "entity_type", "n")


def entity_sets(ents: DataFrame, keys=("file_id", "file_path")) -> DataFrame:
    """Sorted type set and entity count per key, from entities or from
    their counts ``n`` by type."""
    n = F.sum("n") if "n" in ents.columns else F.count(F.lit(1))
    return ents.groupBy(*keys).agg(F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
                                   n.alias("entity_count"))


def with_breach(sets: DataFrame, types_col: str = "entity_types") -> DataFrame:
    t = F.col(types_col)
    return sets.withColumn("breach_trigger", P.breach_trigger(t)) \
        .withColumn("classification", P.breach_label(t)) \
        .withColumn("breach_reasons", P.breach_reasons(t))


def with_tier(sets: DataFrame, types_col: str = "entity_types") -> DataFrame:
    tier = P.set_tier(F.col(types_col))
    return sets.withColumn("tier", tier).withColumn("tier_name", P.tier_name(tier)) \
        .withColumn("classification", P.tier_key(tier))


def breach_files(ents: DataFrame, keys=("file_id", "file_path")) -> DataFrame:
    """C4: files whose type set triggers breach notification."""
    return with_breach(entity_sets(ents, keys)).where("breach_trigger")


def classified_files(ents: DataFrame, keys=("file_id", "file_path"), min_tier: int | None = None) -> DataFrame:
    """C7 (+P13): tier per file; files with no entity >= t are absent (Q7)."""
    out = with_tier(entity_sets(ents, keys)).drop("classification")
    if min_tier is not None:
        out = out.where(F.col("tier") >= min_tier)
    return out


def simple_highrisk(ents: DataFrame) -> DataFrame:
    """Entities whose type is in the simple policy, with category.

    The policy dimension is a fixed 18-entry map: a ``create_map`` lookup,
    no join at all.
    """
    cat = P.display_name(F.col("entity_type"), P.SIMPLE_CATEGORIES)
    return ents.where(F.col("entity_type").isin(*P.SIMPLE_CATEGORIES)) \
        .withColumn("category", cat) \
        .withColumn("masked", M.mask_simple(F.col("text"), F.col("entity_type")))


def category_counts(ents: DataFrame, keys=("file_path",), names=P.STRICT_DISPLAY_NAMES) -> DataFrame:
    """Entity count per (file, display category)."""
    return ents.withColumn("category", P.display_name(F.col("entity_type"), names)) \
        .groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def breach_summary(breach: DataFrame) -> DataFrame:
    """Files per label plus files per component flag (Q17: a HIGH-RISK
    file is counted under every component it holds)."""
    comps = P.breach_components(F.col("entity_types"))
    per_label = breach.groupBy("classification").agg(F.count(F.lit(1)).alias("files"))
    per_label = per_label.select(F.lit("label").alias("kind"), F.col("classification").alias("name"), "files")
    per_comp = breach.select(F.explode(comps).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    per_comp = per_comp.select(F.lit("component").alias("kind"), "name", "files")
    return per_label.unionByName(per_comp)


def tier_summary(classified: DataFrame) -> DataFrame:
    """Files per tier."""
    return classified.groupBy("tier", "tier_name").agg(F.count(F.lit(1)).alias("files"))


def tier_types(classified: DataFrame) -> DataFrame:
    """Per file tier, the union of types that belong to that tier's list."""
    ex = classified.select("tier", F.explode("entity_types").alias("entity_type"))
    ex = ex.where(P.type_tier(F.col("entity_type")) == F.col("tier"))
    return ex.groupBy("tier").agg(F.array_sort(F.collect_set("entity_type")).alias("types"))
