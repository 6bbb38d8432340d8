"""Line deduplication by a deletion-neighbourhood join (DataFrame functions
only).

Lines are compared lower-cased with white-space runs as one space.
Lines with at least MIN_CHARS characters take part; from EDIT_CHARS on, one
edit (a character inserted, deleted or replaced) is tolerated.  The earliest
line, by (doc_id, line number), stays; a later one goes if any earlier line
equals it or is one edit away.

Equal lines are one line first.  Then an edit lies in one of three thirds of
the longer line, and all outside that third is equal: only lines that share
such an outside with another line enter the neighbourhood join.  They emit
every deletion variant of the third as a hashed key; equal keys are joined to
the earliest line of the key, never to each other, and the edit distance of
each joined pair is verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, id_and_text, stored, unused

MIN_CHARS = 10
EDIT_CHARS = 20
#: characters of a block within which the deletion variants are spelled out
BLOCK = 32
#: a table of at most so many rows of two longs (16 MB) is broadcast, a larger one is shuffled
BROADCAST_ROWS = 1_000_000


def normal(line: str) -> str:
    """SQL: the form in which lines are compared."""
    runs = f"regexp_replace({line}, '[ \\\\t\\\\x0B\\\\f\\\\r]+', ' ')"
    odd = " OR ".join(f"contains({line}, {c})" for c in ("'  '", "'\\t'", "'\\r'", "char(11)", "char(12)"))
    return f"lower(btrim(CASE WHEN {odd} THEN {runs} ELSE {line} END, ' '))"


def _outside(t: str, s: int) -> str:
    """SQL: hash of what a line of length t or t - 1 has outside third s."""
    return f"xxhash64({t}, {s}, left(line, {t} * {s} div 3), right(line, {t} - {t} * {s + 1} div 3))"


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def line_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, pos of every line that goes (distinct), from doc_id, text."""
    lines = (docs.where("doc_id IS NOT NULL")
             .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
             .select("doc_id", "pos", F.expr(normal("raw")).alias("line"))
             .withColumn("size", F.length("line"))
             .withColumn("h", F.xxhash64("line", "size")))
    outsides = ", ".join(_outside(t, s) for t in ("size", "(size + 1)") for s in range(3))
    keys = F.expr(f"CASE WHEN size >= {EDIT_CHARS} THEN array({outsides}) END").alias("keys")
    # the texts are read once; all but the few lines near another need hashes only.  A filter before
    # the table is written would be pushed below and normalise each line once more.
    lines = stored(lines.select("doc_id", "pos", "h", "size", keys), "occurrences").where(f"size >= {MIN_CHARS}")
    distinct = stored(lines.groupBy("h").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")),
        "lines")

    # lines that share all but a third with another line
    keyed = distinct.where("keys IS NOT NULL").select("h", F.posexplode("keys").alias("at", "key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
    near = stored(keyed.join(shared, "key"), "near")
    wanted = stored(near.select("h").distinct().join(distinct, "h").select(
        "h", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos")), "wanted")
    texts = docs.select("doc_id", "text").join(_small(wanted), "doc_id").select(
        "h", F.expr(normal("get(split(text, '\\n'), pos)")).alias("line"))
    # another text under a repeated id may have another line there
    texts = stored(texts.withColumn("size", F.length("line")).where("h = xxhash64(line, size)")
                   .dropDuplicates(["h"]), "texts")

    part = near.join(texts, "h").withColumns({
        "s": F.col("at") % 3, "t": F.expr("size + at div 3")}).withColumn(
        "window", F.expr("substr(line, t * s div 3 + 1, size - t * s div 3 - (t - t * (s + 1) div 3))"))
    # a variant is hashed as what stands before its block, the block without a character, and what follows;
    # the shorter line's own keys leave the place of that character out of each block
    cut = "concat(substr(z.block, 1, i - 1), substr(z.block, i + 1))"
    longer = part.where("t = size AND window != ''").select("h", F.expr(f"""flatten(flatten(transform(
        sequence(0, (length(window) - 1) div {BLOCK}), b -> get(transform(array(named_struct(
            'p', xxhash64(substr(window, 1, cast(b * {BLOCK} AS int))),
            's', xxhash64(substr(window, cast((b + 1) * {BLOCK} + 1 AS int))),
            'block', substr(window, cast(b * {BLOCK} + 1 AS int), {BLOCK}))),
          z -> transform(sequence(1, length(z.block)), i -> array(
            xxhash64(key, b, z.p, z.s, {cut}, i), xxhash64(key, b, z.p, z.s, {cut}, 0)))), 0))))""").alias("v"),
        F.lit(False).alias("own"))
    shorter = part.where("t > size").select("h", F.expr(f"""transform(sequence(0, length(window) div {BLOCK}),
        b -> xxhash64(key, b, xxhash64(substr(window, 1, cast(b * {BLOCK} AS int))),
            xxhash64(substr(window, cast((b + 1) * {BLOCK} AS int))),
            substr(window, cast(b * {BLOCK} + 1 AS int), {BLOCK - 1}), 0))""").alias("v"), F.lit(True).alias("own"))
    variants = longer.union(shorter).select("h", "own", F.explode(F.array_distinct("v")).alias("v"))
    equal = variants.groupBy("v").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("v")
    firsts = distinct.select("h", "first")
    members = stored(variants.join(equal, "v").join(firsts, "h"), "members")
    # replaced: to the earliest of the key; inserted or deleted: between the shorter line and the longer ones
    lead = F.struct("first", "h")
    best = members.groupBy("v").agg(
        F.min(lead).alias("e"), F.min(F.when(F.col("own"), lead)).alias("o"),
        F.min(F.when(~F.col("own"), lead)).alias("l"))
    joined = members.join(best, "v")
    pairs = joined.where("o IS NULL AND e.h != h").select("h", F.col("e.h").alias("g")).union(
        joined.where("o IS NOT NULL AND NOT own AND o.first < first").select("h", F.col("o.h").alias("g"))).union(
        joined.where("own AND l.first < first").select("h", F.col("l.h").alias("g")))
    x = texts.select("h", F.col("line").alias("x"))
    y = texts.select(F.col("h").alias("g"), F.col("line").alias("y"))
    late = (stored(pairs.distinct(), "pairs").join(x, "h").join(y, "g")
            .where(F.levenshtein("x", "y", 1).between(0, 1)).select("h").distinct().withColumn("late", F.lit(True)))
    fate = stored(distinct.select("h", "first").join(late, "h", "left"), "fate")
    for table in (near, wanted, texts, members, distinct):  # the others are still read
        drop(table)
    gone = (F.col("late").isNotNull() | (F.col("first") != F.struct("doc_id", "pos")))
    return lines.select("doc_id", "pos", "h").join(fate, "h").where(gone).select("doc_id", "pos").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with the lines that go cut out of the text, and their number
    as ``removed_col`` (n_removed, if not named; with underscores before it
    where ``docs`` has a column of that name).

    Lines end at line feeds; blank lines and lines under MIN_CHARS always
    stay.  Null and empty texts stay as they are.  Rows without an id keep
    their text and are nobody's earlier copy.  Rows that share an id count as
    one document: what goes, goes by line number from each of them.  An empty
    table gives an empty result.  All columns are kept, whatever their names.
    """
    own, gone_col = unused(docs.columns, "_id", "_gone")
    removed_col = removed_col or unused(docs.columns, "n_removed")[0]
    gone = line_decisions(id_and_text(docs, id_col, text_col))
    cut = gone.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list("pos")).alias(gone_col))
    both = docs.join(cut, F.col(id_col) == F.col(own), "left")
    lines = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_col))
    text = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(
        F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i))))
    n = F.when(F.col(text_col).isNull() | F.col(gone_col).isNull(), 0).otherwise(F.size(gone_col))
    return both.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns),
                       n.cast("long").alias(removed_col))
