"""Quality rules with thresholds that the corpus itself sets.

Each document's counts are turned into a few rates.  Mergeable quantile
sketches (KLL, fixed size) of every rate are aggregated per language and
source and merged upwards to languages and to the whole corpus.  Documents
that fail the base rule are judged already and not sketched.  A group's upper
bound of a rate is a tail quantile plus a multiple of the distance from there
to the median; a group with few documents takes the bounds of its language or
of the corpus.  The bounds are joined to the documents and filter
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import stored

#: rate -> (tail quantile, least bound).  A quarter of a group may be junk of symbols, a tenth of the other kinds.
#: Where the tail has none of a kind, the sketch's spread is 0 and the least bound decides: a symbol in 50
#: characters, one line in four repeated, a seventh of the words, a capital in 50 letters
RATES = {"symbol_rate": (0.75, 0.02), "dup_line_rate": (0.9, 0.25), "repeat_rate": (0.9, 0.15), "odd_case_rate": (0.9, 0.02)}
SPREADS = 8.0
MIN_GROUP = 50
#: groups up to which the bounds are broadcast (100 bytes each); more are shuffled
BROADCAST_GROUPS = 100_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@W.tidied
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        for piece in W.pieces(batch):
            buf, offsets = W.flat(piece.column(3))
            words = W.Words(buf, offsets)
            n = words.n_docs

            def per_doc(mask):
                total = np.concatenate(([0], np.cumsum(mask)))
                return total[offsets[1:]] - total[offsets[:-1]]

            solid = ~W.SPACE[buf]
            # lines: after each break and at each text's start
            breaks = np.flatnonzero(buf == 10)
            begin = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
            begin = begin[begin < len(buf)] if len(buf) else begin[:0]
            end = np.append(begin[1:], len(buf)) if len(begin) else begin
            end = end - ((end > begin) & (buf[np.maximum(end, 1) - 1] == 10)) if len(begin) else end
            filled = np.concatenate(([0], np.cumsum(solid)))
            full = filled[end] > filled[begin]
            begin, end = begin[full], end[full]
            line_doc = np.searchsorted(offsets, begin, "right") - 1
            lines = np.bincount(line_doc, minlength=n)
            distinct, _ = W.distinct_by_doc(line_doc, words.hashes(False, begin, end))
            # words in 3-word windows that occur twice or more
            windows, at = W.shingles(words.hashes(False), words.doc, 3)
            order = np.lexsort((windows, words.doc[at]))
            same = (windows[order][1:] == windows[order][:-1]) & (words.doc[at[order]][1:] == words.doc[at[order]][:-1])
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + 3, -1)
            covered = np.cumsum(cover)[:-1] > 0
            upper = (buf >= 65) & (buf <= 90)
            columns = [words.counts, per_doc(solid & ((buf & 0xC0) != 0x80)), per_doc(symbol[buf]),
                       lines - np.bincount(distinct, minlength=n),
                       np.bincount(words.doc[covered], minlength=n), lines, per_doc(upper),
                       per_doc(upper | ((buf >= 97) & (buf <= 122)))]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), piece.column(2), *(pa.array(c.astype(np.int64)) for c in columns)],
                names=["doc_id", "lang", "source", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the COUNTS of every text (null: none).

    n_upper and n_letters count A-Z and A-Za-z; n_lines lines with a word.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        _counts, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def _rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "symbol_rate": F.expr("n_symbols / greatest(word_chars, 1)"),
        "dup_line_rate": F.expr("n_dup_lines / greatest(n_lines, 1)"),
        "repeat_rate": F.expr("n_repeat_words / greatest(n_words, 1)"),
        "odd_case_rate": F.expr("n_upper / greatest(n_letters, 1)")})


def thresholds(rates: DataFrame) -> DataFrame:
    """lang, source and the upper bound of each rate, one row per group.

    Groups are null-safe: rows without language or source form their own.
    """
    sketched = rates.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(r).alias(r) for r in RATES))
    merged = sketched.rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), *(F.kll_merge_agg_double(r).alias(r) for r in RATES))

    def bound(rate: str, far: float, least: float) -> Column:
        middle, tail = (F.kll_sketch_get_quantile_double(F.col(rate), F.lit(q)) for q in (0.5, far))
        return F.greatest(F.lit(least), tail + SPREADS * (tail - middle))
    bounds = merged.select("lang", "source", "level", "n", F.struct(
        *(bound(r, *way).alias(f"max_{r}") for r, way in RATES.items())).alias("b"))
    own = bounds.where("level = 0").select("lang", "source", "n", "b")
    lang = bounds.where("level = 1").select(F.col("lang").alias("l"), F.col("n").alias("ln"), F.col("b").alias("lb"))
    every = bounds.where("level = 3").select("b")
    picked = own.join(lang, own.lang.eqNullSafe(lang.l)).select(
        "lang", "source", F.when(F.col("n") >= MIN_GROUP, F.col("b")).when(F.col("ln") >= MIN_GROUP, F.col("lb"))
        .otherwise(every.scalar()).alias("b"))
    return picked.select("lang", "source", "b.*")


def apply_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, counts, base_failed, kept of every row of ``docs``.

    Empty, blank and null texts have zero counts and fail the base rule.
    Repeated rows are judged (and counted in the sketches) one by one; null
    languages and sources are groups of their own; an empty table gives an
    empty result.  Extra columns are ignored.
    """
    # counted once; the sketches and the filter read the written counts
    rates = _rates(stored(measure(docs, **columns), "counts"))
    bounds = thresholds(rates.where(~base_failed()))
    ok = " AND ".join(f"r.{r} <= t.max_{r}" for r in RATES)
    bounds = stored(bounds, "bounds")
    r, t = rates.alias("r"), (F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds).alias("t")
    judged = r.join(t, F.expr("r.lang <=> t.lang AND r.source <=> t.source"), "left")
    return judged.select("doc_id", *(F.col(c) for c in COUNTS[:5]), base_failed().alias("base_failed"),
                         (~base_failed() & F.coalesce(F.expr(ok), F.lit(False))).alias("kept"))
