"""One query per operator, under its contract, with production parameters and
over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return put


@query("op3_jaccard_join", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))) END AS ss
  FROM w),
c AS (SELECT min(doc_id) AS id, len(ss) AS n, list_sort(ss) AS ss FROM s WHERE len(ss) > 0 GROUP BY ss, len(ss)),
cl AS (SELECT min(id) AS id, any_value(n) AS n, ss FROM c GROUP BY ss),
p AS (SELECT id, n, unnest(ss) AS sh FROM cl),
l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.sh = b.sh AND a.id < b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE t(id, r) AS (SELECT id, id FROM cl UNION SELECT e.b, t.r FROM t JOIN e ON e.a = t.id)
  SELECT id, min(r) AS r FROM t GROUP BY id)
SELECT s.doc_id, len(s.ss)::BIGINT AS n_shingles, coalesce(r.r, s.doc_id)::BIGINT AS component_id
FROM s LEFT JOIN cl ON cl.ss = list_sort(s.ss) AND len(s.ss) > 0 LEFT JOIN r ON r.id = cl.id
""")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip
    return round_trip(read_table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_rules
    return apply_rules(read_table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as t
    docs = read_table(spark, sf_dir, "documents")
    model = t.train(docs, read_table(spark, sf_dir, "labels"), learn=~t.held_out())
    return t.score(docs, model).select(
        "doc_id", F.coalesce(t.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= t.THRESHOLD).cast("int").alias("predicted"), "spans")


@query("op10_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + length(esc) + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return chat.chat_digests(chat.events_of_turns(turns.union(own)))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding as s
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", s.text_size().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    return s.assign_shards(docs, ["text_crc32", "text_hash", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query("op6_line_dedup", """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
n AS (
  SELECT doc_id, pos, raw, trim(regexp_replace(lower(raw),
    '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ') AS line FROM raw),
d AS (SELECT line, length(line) AS size, min({'doc_id': doc_id, 'pos': pos}) AS first FROM n WHERE length(line) >= 10 GROUP BY line),
p AS (
  SELECT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb FROM d a JOIN d b
    ON a.size = b.size AND left(a.line, a.size // 2) = left(b.line, a.size // 2) AND a.line < b.line AND a.size >= 20
  UNION ALL SELECT a.line, b.line, a.first, b.first FROM d a JOIN d b
    ON a.size = b.size AND right(a.line, a.size - a.size // 2) = right(b.line, a.size - a.size // 2) AND a.line < b.line AND a.size >= 20
  UNION ALL SELECT a.line, b.line, a.first, b.first FROM d a JOIN d b
    ON a.size + 1 = b.size AND left(a.line, a.size // 2) = left(b.line, a.size // 2) AND a.size >= 20
  UNION ALL SELECT a.line, b.line, a.first, b.first FROM d a JOIN d b
    ON a.size + 1 = b.size AND right(a.line, a.size - a.size // 2) = right(b.line, a.size - a.size // 2) AND a.size >= 20),
late AS (SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS line FROM p WHERE levenshtein(a, b) <= 1),
k AS (
  SELECT n.doc_id, n.pos, n.raw, d.line IS NOT NULL AND (late.line IS NOT NULL OR d.first <> {'doc_id': n.doc_id, 'pos': n.pos}) AS gone
  FROM n LEFT JOIN d ON d.line = n.line LEFT JOIN late ON late.line = n.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  (count(*) FILTER (gone))::BIGINT AS n_removed
FROM k GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages
    return repeated_passages(read_table(spark, sf_dir, "documents"))


@query("op1_nearest")
def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest
    return nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def _clusters_sql(centroids: int = 8, rounds: int = 10) -> str:
    """Each round as a pair of tables: who is nearest, and where the centroids go."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT rid, cluster, d FROM (
    SELECT rid, cluster, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c ON x.i = c.i GROUP BY rid, cluster)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)"""
    moved = """c{s} AS MATERIALIZED (
  SELECT c.cluster, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v)::BIGINT AS v
  FROM c{r} c LEFT JOIN (SELECT cluster, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY cluster, i) m
    ON c.cluster = m.cluster AND c.i = m.i)"""
    steps = [part.format(r=r, s=r + 1) for r in range(rounds) for part in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT rid, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM kept),
c0 AS MATERIALIZED (
  SELECT cluster, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v FROM kept) WHERE cluster < {centroids}),
{''','''.join(steps)},
h AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY cluster)
SELECT kept.vec_id, a.cluster::INTEGER AS cluster, a.d AS distance,
  (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN h ON h.cluster = a.cluster
"""


@query("op11_centroids", _clusters_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans import cluster
    return cluster(read_table(spark, sf_dir, "embeddings"))


@query("op12_lexical", """
WITH t AS MATERIALIZED (
  SELECT rid, doc_id, unnest(ws) AS term FROM (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents WHERE doc_id IS NOT NULL)),
p AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY rid, doc_id, term),
n AS MATERIALIZED (SELECT rid, sum(tf)::BIGINT AS n FROM p GROUP BY rid),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT rid, 25 + (75 * n * docs) // terms AS m FROM n, g),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY item_id, term),
s AS (
  SELECT item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""")
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked_documents
    return ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
