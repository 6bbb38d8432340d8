"""Dictionary terms in any script against brute force, by both plans."""

import random

import pytest
import regex

from tessera.operators import terms as T

UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
WORD = regex.compile(rf"{UNSPACED}\p{{M}}*|(?:(?!{UNSPACED})[\p{{L}}\p{{M}}\p{{N}}])+")


def words(text):
    return [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text or "")]


def brute(docs, terms):
    out = []
    phrases = {(k, tuple(w for _, _, w in words(t))) for k, t in terms}
    for i, text in docs:
        w = words(text)
        found = {(k, w[a][0], w[a + len(p) - 1][1]) for k, p in phrases for a in range(len(w) - len(p) + 1)
                 if tuple(x for _, _, x in w[a:a + len(p)]) == p}
        out += [(i, k, s, e, text[s:e]) for k, s, e in found if not any(
            k == k2 and s2 <= s and e <= e2 and (s2, e2) != (s, e) for k2, s2, e2 in found)]
    return sorted(out)


def both(spark, docs, terms):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    t = spark.createDataFrame(terms, "entity_type string, term string")
    got = [sorted((r.doc_id, r.entity_type, r.start, r.end, r.text) for r in T.detect_terms(d, t, automaton=a).collect())
           for a in (True, False)]
    assert got[0] == got[1]
    return got[0]


def test_terms_of_many_scripts(spark):
    docs = [(1, "Поездка в МОСКВА-сити и москвань"), (2, "東京都に行く、東京。"), (3, "a pe a day; Peña, PEÑA ñ"), (4, "ประเทศไทย"),
            (5, "Ärzte ohne Grenzen/MSF"), (6, "new-york New  York newyork"), (7, None), (8, ""), (9, "12 Αθήνα 12a"), (10, "𝒳 😀 x")]
    terms = [("LOCATION", "Москва"), ("LOCATION", "東京"), ("NRP", "Peña"), ("LOCATION", "ไทย"), ("ORG", "ärzte ohne grenzen"),
             ("ORG", "Grenzen"), ("LOCATION", "New York"), ("LOCATION", "αθήνα"), ("NUMBER", "12"), ("LETTER", "x"),
             ("PERSON", "Peña")]
    got = both(spark, docs, terms)
    assert got == brute(docs, terms)
    assert {(i, t) for i, _, _, _, t in got} == {
        (1, "МОСКВА"), (2, "東京"), (3, "Peña"), (3, "PEÑA"), (4, "ไทย"), (5, "Ärzte ohne Grenzen"), (6, "new-york"),
        (6, "New  York"), (9, "12"), (9, "Αθήνα"), (10, "x")}


def test_random_texts_match_brute_force(spark):
    r = random.Random(3)
    parts = ["a", "B", "ñ", "Ж", "ж", "東", "京", "か", "1", "é", " ", " ", "-", "、", "é"]

    def some(n):
        return "".join(r.choice(parts) for _ in range(r.randint(1, n)))
    docs = [(i, some(30)) for i in range(150)]
    terms = [(r.choice("XYZ"), t) for t in (some(6) for _ in range(120)) if words(t)]
    assert both(spark, docs, terms) == brute(docs, terms)


def test_many_terms(spark):
    """100,000 terms; each text holds two of them."""
    r = random.Random(5)
    names = sorted({"".join(r.choice("абвгдежзик") for _ in range(9)) for _ in range(100_500)})[:100_000]
    picks = [(i, *r.sample(range(len(names)), 2)) for i in range(300)]
    docs = spark.createDataFrame([(i, f"x{names[a]} {names[a].upper()}, {names[b]}") for i, a, b in picks], "doc_id long, text string")
    t = spark.createDataFrame([("NAME", n) for n in names], "entity_type string, term string")
    got = sorted((x.doc_id, x.text.lower()) for x in T.detect_terms(docs, t).collect())
    assert got == sorted((i, names[x]) for i, a, b in picks for x in (a, b))


def test_a_term_that_cannot_be_found_is_an_error(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for bad in ("", "+-", None, "😀"):
        with pytest.raises(ValueError):
            T.detect_terms(docs, spark.createDataFrame([("X", "x"), ("X", bad)], "entity_type string, term string"))
    none = spark.createDataFrame([], "entity_type string, term string")
    assert T.detect_terms(docs, none).count() == 0 and T.detect_terms(docs, none, automaton=False).count() == 0


def test_same_ids_are_rows_of_their_own(spark):
    docs = [(1, "a b"), (1, "a b"), (1, "b"), (None, "a")]
    got = both(spark, [(i or 0, t) for i, t in docs], [("X", "a b"), ("X", "b"), ("X", "a")])
    assert [g[4] for g in got] == ["a", "a b", "a b", "b"] or sorted(g[4] for g in got) == ["a", "a b", "a b", "b"]


def test_one_file_is_spread(spark, tmp_path):
    """The rows of one small file are the work of all slots, not of one task."""
    spark.createDataFrame([(i, f"in Oslo {i}") for i in range(20)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    terms = spark.createDataFrame([("LOCATION", "oslo")], "entity_type string, term string")
    for automaton in (True, False):
        rows = T.detect_terms(docs, terms, automaton=automaton)
        assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 20
