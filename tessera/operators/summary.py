"""Executive summaries and text reports as ordered line rows.

A report is a DataFrame ``(section, ord, line)``; each block is a small
aggregate turned into lines, and blocks are unioned.  Sorting by
(section, ord) gives the text.  The reference's "Generated: now" line takes
an explicit ``as_of`` string instead of the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import policy as P
from . import classify as C
from . import timeseries as TS

# fixed values: summary texts
BREACH_TITLE = "NC §75-61 BREACH NOTIFICATION EXECUTIVE SUMMARY"
TIER_TITLE = "UNC DATA CLASSIFICATION EXECUTIVE SUMMARY"
REPORT_TITLE = "NC §75-61 Breach Notification Analysis Report"
REPORT_INTRO = "Files triggering NC §75-61 breach notification requirements:"
REPORT_FOUND = "files that would trigger breach notification"
REPORT_LAW = "requirements under North Carolina law (§75-61)."
LAST_RANK = 9223372036854775807
# places of a report's blocks within a file; a block may have as many lines as fit before the next
TYPES, REASONS, SAMPLES, END = 10, 100_000_000, 200_000_000, 2_000_000_000
RISK_AREAS = [
    ("PII-SSN", "files contain names with Social Security Numbers"),
    ("PII-FIN", "files contain names with financial account information"),
    ("PII-GOV", "files contain names with government ID numbers"),
    ("CREDS", "files contain credential pairs (username/email with password)"),
]
SEPARATOR = "-" * 80
DETAIL_TITLE = "UNC DATA CLASSIFICATION DETAILED REPORT"
DETAIL_EXAMPLES = 5


def _lines(spark: SparkSession, section: int, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(texts)], "section int, ord int, line string")


def _one(df: DataFrame, section: int, ord_: int, line) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(ord_).alias("ord"), line.alias("line"))


def _rows(df: DataFrame, section: int, first: int, *lines) -> DataFrame:
    """The lines that are not null, numbered from ``first``; all from one
    evaluation of the row."""
    return df.select(F.posexplode(F.array(*lines)).alias("k", "line")).where(F.col("line").isNotNull()).select(
        F.lit(section).alias("section"), (F.col("k") + first).alias("ord"), "line")


def progress_block(files: DataFrame, jobs: DataFrame, section: int) -> DataFrame:
    """Registered / completed (share) / pending / in progress / error,
    then elapsed time, rate and ETA."""
    c = files.agg(F.count(F.lit(1)).alias("reg"), F.count_if(F.col("status") == "completed").alias("done"),
                  F.count_if(F.col("status") == "pending").alias("pend"),
                  F.count_if(F.col("status") == "processing").alias("proc"),
                  F.count_if(F.col("status") == "error").alias("err"))
    pct = F.format_string("%.1f", F.col("done") * 100.0 / F.col("reg"))

    def count(label, name):
        return F.concat(F.lit(f"  {label}: "), F.col(name).cast("string"), F.lit(" files"))
    counts = _rows(c, section, 0, F.concat(F.lit("Files Registered in Database: "), F.col("reg").cast("string")),
                   F.lit("Analysis Progress:"),
                   F.concat(F.lit("  Completed: "), F.col("done").cast("string"), F.lit(" files ("), pct,
                            F.lit("% of registered)")),
                   count("Pending", "pend"), count("In Progress", "proc"), count("Error", "err"))
    eta = TS.eta_pending(jobs, files).orderBy(F.desc("job_id")).limit(1)
    times = _rows(eta, section, 6, F.lit("Processing Time Statistics:"),
                  F.concat(F.lit("  Total Processing Time: "), F.col("elapsed_time_formatted")),
                  F.concat(F.lit("  Processing Rate: "), F.format_string("%.1f", F.col("files_per_hour")),
                           F.lit(" files/hour")),
                  F.when(F.col("estimated_completion_hours") > 0, F.concat(
                      F.lit("  Estimated Time to Completion: "), F.col("estimated_completion_time"))))
    return counts.unionByName(times)


def type_block(files: DataFrame, section: int) -> DataFrame:
    """'File Types:' and one line per type, most frequent first."""
    t = files.where(F.col("file_type").isNotNull() & (F.col("file_type") != "")) \
        .groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.orderBy(F.desc("n"), "file_type"))
    lines = t.select(F.lit(section).alias("section"), rn.alias("ord"),
                     F.concat(F.lit("  "), F.col("file_type"), F.lit(": "), F.col("n").cast("string"), F.lit(" files"))
                     .alias("line"))
    return _lines(files.sparkSession, section, ["File Types:"]).unionByName(lines)


def breach_summary_lines(spark: SparkSession, files: DataFrame, jobs: DataFrame, ents: DataFrame,
                         as_of: str) -> DataFrame:
    """C10 (strict policy): header, progress, file types, high-risk count,
    files per label (in the reference's key order), top risk areas."""
    b = C.breach_files(ents)
    n = b.agg(F.count(F.lit(1)).alias("n"))
    labels = b.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    key_order = F.create_map(*[x for i, (_, lab) in enumerate(sorted(P.BREACH_LABELS)) for x in (F.lit(lab), F.lit(i))])
    per_label = labels.select(F.lit(40).alias("section"), F.element_at(key_order, F.col("classification")).alias("ord"),
                              F.concat(F.lit("  "), F.col("classification"), F.lit(": "), F.col("n").cast("string"),
                                       F.lit(" files")).alias("line"))
    risk = labels.join(spark.createDataFrame([(lab, i, txt) for i, (lab, txt) in enumerate(RISK_AREAS)],
                                             "classification string, k int, txt string"), "classification")
    risk = risk.select(F.lit(50).alias("section"), (F.col("k") + 1).alias("ord"),
                       F.concat(F.lit("  • "), F.col("n").cast("string"), F.lit(" "), F.col("txt")).alias("line"))
    parts = [
        _lines(spark, 0, [BREACH_TITLE, f"Generated: {as_of}", ""]),
        progress_block(files, jobs, 10),
        type_block(files, 20),
        _lines(spark, 30, [""]).unionByName(_one(n, 30, 1, F.concat(
            F.lit("HIGH-RISK FILES: "), F.col("n").cast("string"),
            F.lit(" files contain personal information subject to breach notification")))).unionByName(
            _lines(spark, 31, ["", "Files by Risk Category:"])),
        per_label,
        _lines(spark, 45, ["", "Top Risk Areas:"]),
        risk,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tier_summary_lines(spark: SparkSession, files: DataFrame, jobs: DataFrame, ents: DataFrame, as_of: str,
                       min_tier: int = 1) -> DataFrame:
    """C10 (tier policy): header, progress, file types, classified count,
    files per tier, and each tier's own types by display name."""
    c = C.classified_files(ents, min_tier=min_tier)
    n = c.agg(F.count(F.lit(1)).alias("n"))
    per_tier = c.groupBy("tier", "tier_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(40).alias("section"), F.col("tier").alias("ord"),
        F.concat(F.lit("  "), F.col("tier_name"), F.lit(": "), F.col("n").cast("string"), F.lit(" files")).alias("line"))
    tt = C.tier_types(c).select("tier", F.explode("types").alias("t"))
    tt = tt.withColumn("name", P.display_name(F.col("t"))).select("tier", "name").distinct()
    heads = tt.select("tier").distinct().select(F.lit(50).alias("section"), ((3 - F.col("tier")) * 100_000_000).alias("ord"),
                                                F.concat(F.lit("  "), P.tier_name(F.col("tier")), F.lit(":")).alias("line"))
    rn = F.row_number().over(Window.partitionBy("tier").orderBy("name"))
    items = tt.select(F.lit(50).alias("section"), ((3 - F.col("tier")) * 100_000_000 + rn).alias("ord"),
                      F.concat(F.lit("    • "), F.col("name")).alias("line"))
    parts = [
        _lines(spark, 0, [TIER_TITLE, f"Generated: {as_of}", ""]),
        progress_block(files, jobs, 10),
        type_block(files, 20),
        _lines(spark, 30, [""]).unionByName(_one(n, 30, 1, F.concat(
            F.lit("Classified Files: "), F.col("n").cast("string"), F.lit(" files contain sensitive information")))),
        _lines(spark, 31, ["", "Classification Summary:"]),
        per_tier,
        _lines(spark, 45, ["", "Top Sensitive Entity Types by Tier:"]),
        heads, items,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def breach_report_lines(ents: DataFrame, as_of: str | None = None) -> DataFrame:
    """The detailed strict-policy report, one block of lines per
    triggering file, files ordered by entity count (desc) then path.

    ``ord`` within a file: 0-2 header, then type counts, reasons and samples
    (category heading, then up to three masked samples)."""
    from .parallel import ranked
    b = C.breach_files(ents).select("file_id", "file_path", "entity_count", "classification", "entity_types")
    b = ranked(b.withColumn("_nc", -F.col("entity_count")), ["_nc", "file_path"], out="file_rank").drop("_nc")
    head = b.select("file_rank", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.concat(F.lit("File: "), F.col("file_path")).alias("line")),
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("Number of entities: "), F.col("entity_count").cast("string"))
                 .alias("line")),
        F.struct(F.lit(2).alias("ord"), F.concat(F.lit("Classification: "), F.col("classification")).alias("line")),
        F.struct(F.lit(TYPES).alias("ord"), F.lit("Entity types:").alias("line")),
        F.struct(F.lit(REASONS).alias("ord"), F.lit("Breach notification trigger reason:").alias("line")),
        F.struct(F.lit(SAMPLES).alias("ord"), F.lit("Sample entities (max 3 per type):").alias("line")),
        F.struct(F.lit(END).alias("ord"), F.lit(SEPARATOR).alias("line")))).alias("l")).select(
        "file_rank", "l.ord", "l.line")
    t = F.col("entity_types")
    reasons = b.select("file_rank", F.posexplode(F.array_compact(F.array(
        F.when(P.has_name(t) & P.has_sensitive(t),
               F.lit("  - Contains personally identifiable information AND sensitive data")),
        F.when(P.credential_pair(t),
               F.lit("  - Contains credential pair (username/email + password/access code)"))))).alias("k", "line"))
    reasons = reasons.select("file_rank", (F.col("k") + REASONS + 1).alias("ord"), "line")
    e = ents.join(b.select("file_id", "file_rank"), "file_id").withColumn(
        "category", P.display_name(F.col("entity_type"), P.STRICT_DISPLAY_NAMES))
    counts = e.groupBy("file_rank", "category").agg(F.count(F.lit(1)).alias("n"))
    crank = F.row_number().over(Window.partitionBy("file_rank").orderBy(F.desc("n"), "category"))
    counts = counts.withColumn("cr", crank)
    type_lines = counts.select("file_rank", (F.col("cr") + TYPES).alias("ord"),
                               F.concat(F.lit("  - "), F.col("category"), F.lit(": "), F.col("n").cast("string"))
                               .alias("line"))
    w = Window.partitionBy("file_rank", "category").orderBy("start_index", "end_index", "entity_type", "text", "score")
    s = e.withColumn("sn", F.row_number().over(w)).where(F.col("sn") <= 3).join(
        counts.select("file_rank", "category", "cr"), ["file_rank", "category"])
    sample_lines = s.select("file_rank", (F.lit(SAMPLES) + F.col("cr") * 10 + F.col("sn")).alias("ord"),
                            F.concat(F.lit("    - "), M.mask_strict(F.col("text"), F.col("entity_type")),
                                     F.lit(" (confidence: "), F.format_string("%.2f", F.col("score")), F.lit(")"))
                            .alias("line"))
    cat_heads = counts.select("file_rank", (F.lit(SAMPLES) + F.col("cr") * 10).alias("ord"),
                              F.concat(F.lit("  "), F.col("category"), F.lit(":")).alias("line"))
    out = head.unionByName(reasons).unionByName(type_lines).unionByName(cat_heads).unionByName(sample_lines)
    if as_of is None:
        return out
    spark = ents.sparkSession
    header = spark.createDataFrame([(0, i, t) for i, t in enumerate(
        [REPORT_TITLE, f"Generated: {as_of}", "", REPORT_INTRO, ""])], "file_rank int, ord int, line string")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    footer = n.select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("").alias("line")),
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("Found "), F.col("n").cast("string"),
                                                 F.lit(" " + REPORT_FOUND)).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.lit(REPORT_LAW).alias("line")))).alias("l")).select(
        F.lit(LAST_RANK).alias("file_rank"), "l.ord", "l.line")
    return header.unionByName(out).unionByName(footer)


SIMPLE_TITLE = "Files containing high-confidence PII requiring breach notification under NC law:"


def simple_report_lines(ents: DataFrame) -> DataFrame:
    """The simple policy's report, a block of lines per file that holds
    an entity of it, most entities first, then by path: ``(file_rank, ord,
    line)``.

    A file's categories stand by count (descending), then name, each with up
    to three masked samples in the order of the text.  ``ents`` are entities
    above the threshold."""
    from .parallel import ranked
    e = C.simple_highrisk(ents)
    counts = e.groupBy("file_id", "file_path", "category").agg(F.count(F.lit(1)).alias("n"))
    files = counts.groupBy("file_id", "file_path").agg(F.sum("n").alias("total"))
    files = ranked(files.withColumn("_less", -F.col("total")), ["_less", "file_path", "file_id"], out="file_rank")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "category"))
    counts = counts.withColumn("at", place).join(files.select("file_id", "file_rank"), "file_id")

    def line(ord_, *parts):
        return F.struct(F.lit(ord_).cast("int").alias("ord") if not isinstance(ord_, Column) else ord_.cast("int").alias("ord"),
                        F.concat(*parts).alias("line"))
    frame = files.select("file_rank", F.explode(F.array(
        line(0, F.lit("File: "), F.col("file_path")),
        line(1, F.lit("Number of sensitive entities: "), F.col("total").cast("string")),
        line(TYPES, F.lit("Entity types:")), line(SAMPLES, F.lit("Sample entities (max 3 per type):")),
        line(END, F.lit(SEPARATOR)))).alias("l")).select("file_rank", "l.*")
    # a category has its count line and, further down, the heading of its samples
    heads = counts.select("file_rank", F.explode(F.array(
        line(F.col("at") + TYPES, F.lit("  - "), F.col("category"), F.lit(": "), F.col("n").cast("string")),
        line(F.col("at") * 10 + SAMPLES, F.lit("  "), F.col("category"), F.lit(":")))).alias("l")).select("file_rank", "l.*")
    first = Window.partitionBy("file_id", "category").orderBy("start_index", "end_index", "entity_type", "text", "score")
    samples = e.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= 3).join(
        counts.select("file_id", "category", "file_rank", "at"), ["file_id", "category"]).select(
        "file_rank", (F.col("at") * 10 + SAMPLES + F.col("rn")).cast("int").alias("ord"), F.concat(
            F.lit("    - "), F.col("masked"), F.lit(" (confidence: "), F.format_string("%.2f", F.col("score")), F.lit(")")).alias("line"))
    title = ents.sparkSession.createDataFrame([(0, 0, SIMPLE_TITLE), (0, 1, "")], "file_rank long, ord int, line string")
    return title.unionByName(frame).unionByName(heads).unionByName(samples)


def tier_report_lines(ents: DataFrame, counts: DataFrame, as_of: str) -> DataFrame:
    """The detailed tier report, a block of lines per classified file,
    highest tier first, then by path: ``(tier_order, file_path, ord, line)``.

    Types stand most sensitive first; each shows its best five masked
    examples and how many more there are.  ``counts`` is
    ``classify.ledger_type_counts`` of ``ents``."""
    files = C.with_tier(C.entity_sets(counts)).select("file_id", "file_path", "tier", "tier_name")
    order = (3 - F.col("tier")).alias("tier_order")
    frame = files.select(order, "file_path", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.concat(F.lit("File: "), F.col("file_path")).alias("line")),
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("Classification: "), F.col("tier_name")).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.lit("Entities:").alias("line")),
        F.struct(F.lit(END).alias("ord"), F.lit(SEPARATOR).alias("line")))).alias("l")).select(
        "tier_order", "file_path", "l.*")
    own = P.type_tier(F.col("entity_type"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("type_tier"), "entity_type"))
    types = counts.groupBy("file_id", "entity_type").agg(F.sum("n").alias("n")).withColumn("type_tier", own).withColumn(
        "at", place * 10).join(files, "file_id")
    heads = types.select(order, "file_path", F.col("at").alias("ord"), F.concat(
        F.lit("  - "), P.display_name(F.col("entity_type"), P.TIER_DISPLAY_NAMES), F.lit(" ("),
        F.element_at(F.array(*(F.lit(t.split()[1]) for t in P.TIER_NAMES)), F.col("type_tier") + 1), F.lit("):")).alias("line"))
    more = types.where(F.col("n") > DETAIL_EXAMPLES).select(
        order, "file_path", (F.col("at") + DETAIL_EXAMPLES + 1).alias("ord"), F.concat(
            F.lit("    ... and "), (F.col("n") - DETAIL_EXAMPLES).cast("string"), F.lit(" more instances")).alias("line"))
    best = Window.partitionBy("file_id", "entity_type").orderBy(F.desc("score"), "start_index", "end_index", "text")
    examples = ents.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= DETAIL_EXAMPLES).select(
        "file_id", "entity_type", "rn", F.concat(
            F.lit("    "), M.mask_tiered(F.col("text"), F.col("entity_type")), F.lit(" (confidence: "),
            F.format_string("%.2f", F.col("score")), F.lit(")")).alias("line"))
    examples = examples.join(types.select("file_id", "entity_type", "file_path", "tier", "at"), ["file_id", "entity_type"])
    examples = examples.select(order, "file_path", (F.col("at") + F.col("rn")).alias("ord"), "line")
    total = files.agg(F.count(F.lit(1)).alias("n"))
    header = _rows(total, -1, 0, F.lit(DETAIL_TITLE), F.lit(f"Generated: {as_of}"),
                   F.concat(F.lit("Total Files: "), F.col("n").cast("string")), F.lit(SEPARATOR))
    header = header.select(F.col("section").alias("tier_order"), F.lit("").alias("file_path"), "ord", "line")
    return header.unionByName(frame).unionByName(heads).unionByName(more).unionByName(examples)
