"""Dictionary recognizer (D7) for terms in any script.

A word is a run of letters, marks and digits of any script.  Scripts written
without spaces have no such runs, so each of their letters (with its marks) is
a word of its own.  A term matches where its words stand in order, in any
case, whatever stands between them that belongs to no word; so a term's edges
are edges of words: "Peña" does not hit "pe a", and a term of Han letters is
found inside a longer run of them.

Two plans give the same rows.  A dictionary of at most ``AUTOMATON_CHARS``
characters is broadcast, and each Python worker builds one Aho-Corasick
automaton from it: a text is read once, whatever the number of terms, and
nothing is shuffled.  A larger one is joined: every word of a text starts one
phrase per distinct term length, and phrases equi-join the terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recognizers as R
from ..functions.spans import scan
from .parallel import spread

#: scripts without spaces between words
UNSPACED = "".join(f"\\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
WORD = f"[{UNSPACED}]\\p{{M}}*|[\\p{{L}}\\p{{M}}\\p{{N}}&&[^{UNSPACED}]]+"
#: characters of all terms up to which a worker holds them as an automaton (about 100 MB)
AUTOMATON_CHARS = 2_000_000

_HITS = "array<struct<entity_type string, first int, words int>>"


def _phrase(words: Column) -> Column:
    return F.lower(F.array_join(words, " "))


def dictionary(terms: DataFrame) -> DataFrame:
    """entity_type, phrase, term: the phrase is the term's words, lower-cased
    and joined by one space."""
    return terms.select("entity_type", F.coalesce(_phrase(F.regexp_extract_all("term", F.lit(WORD), 0)), F.lit(""))
                        .alias("phrase"), "term")


def _automaton(entries):
    """Hits of one normalised text after another; ``entries`` is a broadcast
    list of (phrase, types)."""
    tag = uuid.uuid4().hex

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sys
        import types

        import ahocorasick
        import pyarrow
        cache = sys.modules.setdefault("_tessera_terms", types.ModuleType("_tessera_terms")).__dict__
        if cache.get("of") != tag:  # one dictionary per worker, kept between tasks
            found = ahocorasick.Automaton()
            for phrase, kinds in entries.value:
                found.add_word(f" {phrase} ", (phrase.count(" ") + 1, kinds))
            found.make_automaton()
            cache["of"], cache["automaton"] = tag, found
        automaton = cache["automaton"]
        kind = pyarrow.list_(pyarrow.struct([("entity_type", pyarrow.string()), ("first", pyarrow.int32()),
                                             ("words", pyarrow.int32())]))

        def hits(text: str) -> list:
            out, at, seen = [], 0, 0
            for end, (n, kinds) in automaton.iter(text) if len(automaton) else ():
                seen, at = seen + text.count(" ", at, end), end
                out += [(k, seen - n, n) for k in kinds]
            kept, last, far = [], None, 0
            for k, i, n in sorted(out, key=lambda h: (h[0], h[1], -h[2])):
                far = 0 if k != last else far
                if i + n > far:  # of one type, what lies inside a longer hit goes
                    kept.append({"entity_type": k, "first": i, "words": n})
                last, far = k, max(far, i + n)
            return kept
        for batch in texts:
            yield pyarrow.array([hits(f" {t} ") if t else [] for t in batch.to_pylist()], kind)
    return F.arrow_udf(run, _HITS)


def _words(df: DataFrame, text_col: str, id_cols) -> DataFrame:
    """Text ``_t``, words ``_w``, the gaps before and after them ``_g``."""
    d = df.select(*id_cols, F.col(text_col).alias("_t")).where(F.col("_t").isNotNull())
    return d.withColumn("_g", F.split("_t", WORD, -1)).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), 0))


def _placed(d: DataFrame) -> DataFrame:
    """Where each gap starts, ``_at``: running lengths of gaps and words."""
    d = d.withColumn("_n", F.zip_with("_g", "_w", lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0))))
    return d.withColumn("_at", scan(F.col("_n"), F.lit(0), lambda a, b: a + b))


def _span(i, n) -> list[Column]:
    """Start and end (code points) of the words from ``i`` on."""
    last = i + n - 1
    return [(F.get("_at", i) + F.length(F.get("_g", i))).alias("start"),
            (F.get("_at", last) + F.length(F.get("_g", last)) + F.length(F.get("_w", last))).alias("end")]


def _by_automaton(d: DataFrame, t: DataFrame, id_cols) -> DataFrame:
    rows = t.groupBy("phrase").agg(F.sort_array(F.collect_set("entity_type")).alias("kinds")).collect()
    entries = d.sparkSession.sparkContext.broadcast([(r["phrase"], list(r["kinds"])) for r in rows])
    d = d.withColumn("_h", _automaton(entries)(_phrase(F.col("_w")))).where(F.size("_h") > 0)
    return _placed(d).select(*id_cols, "_t", "_at", "_g", "_w", F.explode("_h").alias("h")).select(
        *id_cols, "_t", "h.entity_type", *_span(F.col("h.first"), F.col("h.words")))


def _by_join(d: DataFrame, t: DataFrame, id_cols) -> DataFrame:
    lengths = t.agg(F.sort_array(F.collect_set(F.size(F.split("phrase", " "))))).scalar()
    d = _placed(d.withColumn("_row", F.monotonically_increasing_id())).withColumn("_len", lengths)
    rows = F.flatten(F.transform("_w", lambda w, i: F.transform(
        F.filter("_len", lambda n: i + n <= F.size("_w")), lambda n: F.struct(
            _phrase(F.slice("_w", i + 1, n)).alias("phrase"), *_span(i, n)))))
    grams = d.select(*id_cols, "_row", "_t", F.explode(rows).alias("r")).select(
        *id_cols, "_row", "r.phrase", "r.start", "r.end", F.expr("substr(_t, r.start + 1, r.end - r.start)").alias("_t"))
    hits = grams.join(t, "phrase")
    longer = Window.partitionBy("_row", "entity_type").orderBy("start", F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1)
    kept = hits.withColumn("_cover", F.max("end").over(longer)).where("_cover IS NULL OR _cover < end")
    return kept.select(*id_cols, "_t", "entity_type", "start", "end")


def detect_terms(df: DataFrame, terms: DataFrame, text_col: str = "text", id_cols=("doc_id",),
                 score: float = R.SHAPE_SCORE, automaton: bool | None = None) -> DataFrame:
    """Hits ``(id..., entity_type, start, end, score, text)`` of a term
    table ``(entity_type, term)`` of any size, with terms of any number of
    words.  Of hits of one type in a row, one that lies inside a longer one is
    dropped.

    A term without a word (null, empty, only signs) cannot be found; it is an
    error, not dropped.  A row without text has no hits.  ``automaton`` forces
    one plan; by default the dictionary's size decides.
    """
    t = dictionary(terms)
    empty = [r["term"] for r in t.where("phrase = ''").select("term").limit(5).collect()]
    if empty:
        raise ValueError(f"terms without a letter or digit cannot be found: {empty}")
    t = t.select("entity_type", "phrase").distinct()
    if automaton is None:
        automaton = (t.agg(F.sum(F.length("phrase"))).first()[0] or 0) <= AUTOMATON_CHARS
    d = _words(spread(df, id_cols), text_col, id_cols)
    rows = _by_automaton(d, t, id_cols) if automaton else _by_join(d, t, id_cols)
    found = F.expr("substr(_t, start + 1, end - start)") if automaton else F.col("_t")
    return rows.select(*id_cols, "entity_type", "start", "end", F.lit(float(score)).alias("score"), found.alias("text"))
