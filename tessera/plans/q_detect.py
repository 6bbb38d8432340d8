"""Detection queries over the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..sources.tables import read_table
from . import evidence as EV
from . import oracle as O
from .registry import register

SPAN_COLS = ("doc_id", "entity_type", "start", "end", "score", "text")


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _detect_sql(entities, threshold=0.7):
    ctes = O.spans_view(entities, threshold)
    return O.with_views('SELECT doc_id, entity_type, start, "end", score, text FROM spans', extra=ctes)


def _corpus_view(entities, threshold):
    return O.spans_view(entities, threshold, src="corpus", src_sql=EV.CORPUS_SQL)


def _detect_query(key, entities, threshold=0.7):
    sql = O.with_views('SELECT doc_id, entity_type, start, "end", score, text FROM spans',
                       extra=_corpus_view(entities, threshold))

    def build(spark, sf):
        return D.detect_entities(EV.corpus(spark, sf), entities=entities, threshold=threshold)
    build.__doc__ = f"D1/D4-D8 on documents and evidence texts: {', '.join(entities) if entities else 'every type'}."
    register(key, sql)(build)


# one key per recognizer family
_detect_query("detect_email", ["EMAIL_ADDRESS"])
_detect_query("detect_phone", ["PHONE_NUMBER"])
_detect_query("detect_ip", ["IP_ADDRESS"])
_detect_query("detect_ssn", ["US_SSN", "US_ITIN"])
_detect_query("detect_card_luhn", ["CREDIT_CARD"])
_detect_query("detect_iban", ["IBAN_CODE", "AWS_SECRET_KEY"])
_detect_query("detect_routing", ["US_BANK_ROUTING", "UK_NHS", "AU_TFN", "AU_MEDICARE", "US_POSTAL_CODE"])
_detect_query("detect_token", ["ACCESS_CODE"])
_detect_query("detect_cues", [r.entity_type for r in D.R.RECOGNIZERS if r.lane.startswith("cue_")])
_detect_query("detect_markers", ["DIGITAL_SIGNATURE", "BIOMETRIC_IDENTIFIER", "ITAR_CONTROLLED"])
# every type on texts that hold them; without a threshold every candidate with its score (P6 off)
_detect_query("detect_evidence", None)
_detect_query("detect_all_raw", None, None)


@register("detect_all", _detect_sql(None))
def detect_all(spark, sf):
    """Every type in the documents."""
    return D.detect_entities(_docs(spark, sf))


@register("ent_threshold", O.with_views(
    'SELECT doc_id, entity_type, start, "end", score, text FROM spans WHERE score >= 0.9',
    extra=_corpus_view(None, None)))
def ent_threshold(spark, sf):
    """``score >= t`` on detected spans (t = 0.9, inclusive)."""
    return D.detect_entities(EV.corpus(spark, sf), threshold=None).where(F.col("score") >= 0.9)


@register("ent_allowlist", _detect_sql(["EMAIL_ADDRESS", "PHONE_NUMBER"]))
def ent_allowlist(spark, sf):
    """``--entities EMAIL_ADDRESS,PHONE_NUMBER`` prunes the other recognizers."""
    allow = "EMAIL_ADDRESS,PHONE_NUMBER".split(",")
    return D.detect_entities(_docs(spark, sf), entities=allow)


@register("detect_arrays", O.with_views(
    """SELECT d.doc_id, coalesce(c.n, 0) AS n_entities, c.first_start, c.types
       FROM documents d LEFT JOIN (
         SELECT doc_id, CAST(count(*) AS INT) AS n, min(start) AS first_start,
                array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS types
         FROM spans GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
    extra=O.spans_view(None, 0.7)))
def detect_arrays(spark, sf):
    """One span array per document ([] when nothing is found)."""
    arr = D.detect_arrays(_docs(spark, sf))
    return arr.select("doc_id", F.size("entities").alias("n_entities"),
                      F.array_min(F.transform("entities", lambda s: s["start"])).alias("first_start"),
                      F.when(F.size("entities") > 0, F.array_join(F.array_sort(F.array_distinct(
                          F.transform("entities", lambda s: s["entity_type"]))), ",")).alias("types"))


@register("doc_entity_counts", O.with_views(
    """SELECT d.doc_id, CAST(coalesce(c.n, 0) AS INT) AS entity_count, CAST(length(d.text) AS BIGINT) AS text_length
       FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) c
       ON d.doc_id = c.doc_id""",
    extra=O.spans_view(None, 0.7)))
def doc_entity_counts(spark, sf):
    """Entity count (>= 0.7) and text length per document."""
    return D.doc_entity_counts(_docs(spark, sf))


def _catalogue_sql() -> str:
    rows = [(r.entity_type, r.lane, float(r.score), r.check_name, r.context) for r in D.R.RECOGNIZERS]

    def lit(v):
        return "NULL" if v is None else (f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else O.q(v))
    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return O.with_views(
        f"""SELECT c.entity_type, c.lane, c.base_score, c.checksum, c.context, coalesce(n.n_found, 0) AS n_found
            FROM (VALUES {values}) c(entity_type, lane, base_score, checksum, context)
            LEFT JOIN (SELECT entity_type, count(*) AS n_found FROM spans GROUP BY entity_type) n
              ON c.entity_type = n.entity_type""", extra=O.spans_view(None, 0.7))


@register("supported_entities", _catalogue_sql())
def supported_entities(spark, sf):
    """D3: recognizer catalogue joined with detection counts on the corpus."""
    cat = D.supported_entities(spark)
    counts = D.detect_entities(_docs(spark, sf)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_found"))
    return cat.join(F.broadcast(counts), "entity_type", "left").fillna(0, ["n_found"])


def _base_score_sql() -> str:
    whens = " ".join(f"WHEN {O.q(r.entity_type)} THEN CAST({float(r.score)!r} AS DOUBLE)" for r in D.R.RECOGNIZERS)
    return f"CASE entity_type {whens} END"


@register("score_context", O.with_views(
    f"""SELECT doc_id, entity_type, start, "end", {_base_score_sql()} AS base_score, score,
          score > {_base_score_sql()} AS boosted FROM spans""", extra=_corpus_view(None, None)))
def score_context(spark, sf):
    """Base score of each candidate and the score after the context cue
    (a cue word in the 40 characters before the span adds 0.3, cap 1.0)."""
    base = F.create_map(*[x for r in D.R.RECOGNIZERS for x in (F.lit(r.entity_type), F.lit(float(r.score)))])
    s = D.detect_entities(EV.corpus(spark, sf), threshold=None)
    b = F.element_at(base, F.col("entity_type"))
    return s.select("doc_id", "entity_type", "start", "end", b.alias("base_score"), "score",
                    (F.col("score") > b).alias("boosted"))


_PLACES = """SELECT c.c_custkey AS doc_id, concat('Customer ', c.c_custkey, ' ships from ', n.n_name, ', a Nation In the-Region ',
    r.r_name, '; mail to ', lower(n.n_name), CASE WHEN c.c_custkey % 3 = 0 THEN concat('x ', r.r_name, 's') ELSE '.' END) AS text
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


@register("detect_terms", f"""
WITH d AS ({_PLACES}),
t AS (SELECT DISTINCT entity_type, regexp_replace(phrase, '[^a-z0-9]+', ' ', 'g') AS phrase FROM (
  SELECT 'LOCATION' AS entity_type, lower(n_name) AS phrase FROM nation UNION ALL SELECT 'LOCATION', lower(r_name) FROM region
  UNION ALL SELECT 'ROUTE', lower(concat(n_name, ' a nation in the region ', r_name)) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'ROUTE', 'a nation in the region') x),
h AS (
  SELECT d.doc_id, t.entity_type, p AS start, p + length(m) AS "end", m AS text FROM (
    SELECT d.doc_id, d.text, t.entity_type, regexp_extract(substr(d.text, p + 1), '(?i)^' || replace(t.phrase, ' ', '[^A-Za-z0-9]+')) AS m, p
    FROM d, t, unnest(range(length(d.text))) u(p)
    WHERE contains(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g'), t.phrase)) d JOIN t ON t.entity_type = d.entity_type
      AND t.phrase = regexp_replace(lower(m), '[^a-z0-9]+', ' ', 'g')
  WHERE m <> '' AND NOT regexp_matches(substr(d.text, p, CASE WHEN p = 0 THEN 0 ELSE 1 END), '[A-Za-z0-9]')
    AND NOT regexp_matches(substr(d.text, p + length(m) + 1, 1), '[A-Za-z0-9]')),
u AS (SELECT DISTINCT * FROM h)
SELECT doc_id, entity_type, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", CAST({D.R.SHAPE_SCORE!r} AS DOUBLE) AS score, text
FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.doc_id = u.doc_id AND v.entity_type = u.entity_type AND v.start <= u.start
  AND v."end" >= u."end" AND (v.start < u.start OR v."end" > u."end"))""")
def detect_terms(spark, sf):
    """Dictionary recognizer over texts of the customers; terms are the
    nations, the regions, and phrases of five and more words about them."""
    c, n, r = (read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    docs = c.join(places, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("doc_id"), F.expr(
        """concat('Customer ', c_custkey, ' ships from ', n_name, ', a Nation In the-Region ', r_name, '; mail to ',
             lower(n_name), CASE WHEN c_custkey % 3 = 0 THEN concat('x ', r_name, 's') ELSE '.' END)""").alias("text"))
    terms = n.selectExpr("'LOCATION' AS entity_type", "n_name AS term").union(
        r.selectExpr("'LOCATION'", "r_name")).union(
        places.selectExpr("'ROUTE'", "concat(n_name, ' a nation in the region ', r_name)")).union(
        r.selectExpr("'ROUTE'", "'A nation in the region'"))
    return D.detect_terms(docs, terms)


# the nations' names in other scripts: fixed values, letter by letter
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_ "
_SCRIPTS = {"cyr": "АБЦДЕФГХИЙКЛМНОПЯРСТУВЬЫЮЗЖЪЭЧШЩЁІЇЄ",
            "han": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余一二三四五六七八九十",
            "acc": "ÁBÇDÉFGHÍJKLMÑÓPQŔSTÚVWXÝŽĀĒĪŌŪĂĔĬŎŬ"}
_NAMES = "SELECT n_nationkey AS k, " + ", ".join(
    f"translate(upper(n_name), '{_LATIN}', '{to}') AS {c}" for c, to in _SCRIPTS.items()) + " FROM nation"
_SCRIPT_TEXTS = """SELECT c_custkey AS doc_id, concat('№', CAST(c_custkey AS STRING), ' ', cyr, 'ская ', lower(cyr), ', ', han, '人。', acc, ' ',
    lower(acc), 'x ', cyr, '-', acc, CASE WHEN c_custkey % 2 = 0 THEN concat('a', han) ELSE concat(' ', cyr, '  ', acc, 's') END) AS text
  FROM customer JOIN names ON c_nationkey = k"""
_SCRIPT_TERMS = """SELECT 'LOCATION' AS entity_type, cyr AS term FROM names UNION ALL SELECT 'LOCATION', han FROM names
  UNION ALL SELECT 'LOCATION', acc FROM names UNION ALL SELECT 'NRP', concat(han, '人') FROM names
  UNION ALL SELECT 'NRP', substr(han, 2, 3) FROM names UNION ALL SELECT 'ORG', concat(cyr, ' ', acc) FROM names
  UNION ALL SELECT 'ORG', acc FROM names"""


@register("detect_terms_scripts", f"""
WITH names AS ({_NAMES}), d AS ({_SCRIPT_TEXTS.replace('STRING', 'VARCHAR')}), t AS (
  SELECT DISTINCT entity_type, lower(term) AS phrase, regexp_matches(term, '\\p{{Han}}') AS unspaced FROM ({_SCRIPT_TERMS}) x),
c AS (SELECT doc_id, text, entity_type, phrase, unspaced FROM d JOIN t
  ON contains(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), phrase)),
h AS (SELECT *, substr(text, p, 1) AS before, substr(text, p + length(m) + 1, 1) AS after FROM (
    SELECT *, regexp_extract(substr(text, p + 1), '(?i)^' || replace(phrase, ' ', '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS m
    FROM c, unnest(range(length(text))) u(p)) x WHERE m <> ''),
u AS (SELECT DISTINCT doc_id, entity_type, p AS start, p + length(m) AS "end", m AS text FROM h WHERE unspaced
  OR NOT ((p > 0 AND regexp_matches(before, '[\\p{{L}}\\p{{M}}\\p{{N}}]') AND NOT regexp_matches(before, '\\p{{Han}}'))
    OR (regexp_matches(after, '[\\p{{L}}\\p{{M}}\\p{{N}}]') AND NOT regexp_matches(after, '\\p{{Han}}'))))
SELECT doc_id, entity_type, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", CAST({D.R.SHAPE_SCORE!r} AS DOUBLE) AS score, text
FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.doc_id = u.doc_id AND v.entity_type = u.entity_type AND v.start <= u.start
  AND v."end" >= u."end" AND (v.start < u.start OR v."end" > u."end"))""")
def detect_terms_scripts(spark, sf):
    """Names in Cyrillic, Han and accented Latin letters, with near misses,
    one type's hit inside another's, and phrases over signs."""
    names = read_table(spark, sf, "nation").selectExpr("n_nationkey AS k", *(
        f"translate(upper(n_name), '{_LATIN}', '{to}') AS {c}" for c, to in _SCRIPTS.items()))
    customer = read_table(spark, sf, "customer")
    docs = spark.sql(_SCRIPT_TEXTS.replace("customer JOIN", "{customer} JOIN").replace("names", "{names}"), customer=customer, names=names)
    terms = spark.sql(_SCRIPT_TERMS.replace("names", "{names}"), names=names)
    return D.detect_terms(docs, terms)


@register("detect_lateral", O.with_views(
    """SELECT d.doc_id, d.lang, s.entity_type, s.start, s."end", s.score, s.text FROM documents d JOIN spans s ON s.doc_id = d.doc_id
       WHERE s.entity_type <> 'PERSON'""", extra=O.spans_view(None, 0.7)))
def detect_lateral(spark, sf):
    """Detection as a SQL table function in a lateral join."""
    from .views import register_functions
    register_functions(spark)
    return spark.sql("""SELECT d.doc_id, d.lang, s.* FROM {documents} d, LATERAL detect_spans(d.text) s
        WHERE s.entity_type <> 'PERSON'""", documents=read_table(spark, sf, "documents"))
