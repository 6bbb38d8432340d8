"""DuckDB twins of the testbed views and of the span machinery.

These strings are the independent side of the correctness gate: DuckDB
evaluates the same patterns with RE2, computes offsets with list slices and
re-implements every checksum in SQL, so a mismatch points at our Spark
expressions.  Only ANSI-ish SQL plus DuckDB list lambdas is used.
"""

from __future__ import annotations

from ..functions import recognizers as R
from .testbed import ENTITY_CYCLE, ERROR_BY_PRIORITY, EXTENSIONS, OTHER_ERROR


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EXT = ",".join(EXTENSIONS)
_ETYPES = ",".join(ENTITY_CYCLE)
_ERR = " ".join(f"WHEN {q(p)} THEN {q(t)}" for p, t in ERROR_BY_PRIORITY)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "t_files": ((), f"""
SELECT o_orderkey AS file_id, o_custkey % 3 + 1 AS job_id,
  concat('/corpus/job', o_custkey % 3 + 1, '/d', o_orderkey % 7, '/',
         CASE WHEN o_orderkey % 50 = 0 THEN '~$' ELSE '' END, 'f', o_orderkey,
         split_part({q(_EXT)}, ',', CAST(o_orderkey % 8 + 1 AS INT))) AS file_path,
  split_part({q(_EXT)}, ',', CAST(o_orderkey % 8 + 1 AS INT)) AS file_type,
  CASE WHEN o_orderkey % 20 = 4 THEN CAST(0 AS BIGINT) WHEN o_orderkey % 20 = 2 THEN CAST(50 AS BIGINT)
       ELSE CAST(floor(o_totalprice) AS BIGINT) END AS file_size,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending'
       WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'processing' END AS status,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN
    CASE o_orderpriority {_ERR} ELSE {q(OTHER_ERROR)} END END AS error_message,
  o_orderdate AS process_start,
  o_orderdate + (o_orderkey % 3600) * INTERVAL '1' SECOND AS process_end,
  (o_orderkey % 3600) / CAST(10 AS DOUBLE) AS processing_time
FROM orders"""),
    "t_results": (("t_files",), """
SELECT file_id AS result_id, file_id, processing_time,
  CASE WHEN file_id % 4 = 0 THEN '{"extraction_method": "ocr"}' ELSE '{"extraction_method": "tika"}' END AS metadata
FROM t_files WHERE status = 'completed'"""),
    "t_entities": ((), f"""
SELECT l_orderkey AS result_id, l_orderkey AS file_id,
  split_part({q(_ETYPES)}, ',', CAST((l_partkey + l_suppkey) % 42 + 1 AS INT)) AS entity_type,
  CAST(l_linenumber * 10 AS INT) AS start_index, CAST(l_linenumber * 10 + 8 AS INT) AS end_index,
  CAST(50 + round(l_discount * 500) AS INT) / CAST(100 AS DOUBLE) AS score,
  CASE WHEN (l_partkey + l_suppkey) % 42 = 3 THEN concat('user', l_partkey, '@mail', l_suppkey, '.example.com')
       WHEN (l_partkey + l_suppkey) % 42 IN (0, 18, 19) THEN concat('John Q', l_partkey % 10, ' Smith')
       ELSE concat(l_partkey, '-', l_suppkey) END AS text
FROM lineitem"""),
    "t_jobs": (("t_files",), """
SELECT job_id, concat('job', job_id) AS name, start_time, last_updated,
  CASE WHEN open_files = 0 THEN 'completed' ELSE 'running' END AS status,
  concat('scan /corpus/job', job_id) AS command_line, total_files, processed_files, error_files,
  '{"threshold": 0.7}' AS settings
FROM (SELECT job_id, count(*) AS total_files,
        count(*) FILTER (WHERE status = 'completed') AS processed_files,
        count(*) FILTER (WHERE status = 'error') AS error_files,
        count(*) FILTER (WHERE status IN ('pending', 'processing')) AS open_files,
        min(process_start) AS start_time, max(process_end) AS last_updated
      FROM t_files GROUP BY job_id) j"""),
    "t_job_metadata": (("t_jobs",), """
SELECT job_id * 10 + 1 AS metadata_id, job_id, 'directory' AS key, concat('/corpus/job', job_id) AS value FROM t_jobs
UNION ALL
SELECT job_id * 10 + 2 AS metadata_id, job_id, 'threshold' AS key, '0.7' AS value FROM t_jobs"""),
    "t_log": ((), """
SELECT event_id, ts, user_id AS job_id, event_type, value, props FROM events"""),
    "t_docs": ((), "SELECT doc_id, text, lang, source FROM documents"),
}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named views and their dependencies."""
    order: list[str] = []

    def visit(n):
        for d in VIEWS[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order]
    ctes += [f"{n} AS ({s}\n)" for n, s in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# span extraction in DuckDB
# ---------------------------------------------------------------------------

def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _dig(d: str, i: str) -> str:
    return f"CAST(substr({d}, {i}, 1) AS INT)"


def _weighted(d: str, weights: list[int]) -> str:
    w = "[" + ",".join(str(x) for x in weights) + "]"
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: {_dig(d, 'i')} * {w}[i]))"


def check_sql(name: str, x: str) -> str:
    d = _digits(x)
    if name == "luhn":
        term = (f"CASE WHEN (length({d}) - i) % 2 = 1 THEN (CASE WHEN {_dig(d, 'i')} * 2 > 9 THEN "
                f"{_dig(d, 'i')} * 2 - 9 ELSE {_dig(d, 'i')} * 2 END) ELSE {_dig(d, 'i')} END")
        return (f"(length({d}) >= 2 AND list_sum(list_transform(range(1, length({d}) + 1), "
                f"lambda i: {term})) % 10 = 0)")
    if name == "iban":
        s = f"upper(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
        r = f"concat(substr({s}, 5), substr({s}, 1, 4))"
        code = (f"list_transform(range(1, length({r}) + 1), lambda i: CASE WHEN regexp_matches(substr({r}, i, 1), "
                f"'^[0-9]$') THEN CAST(substr({r}, i, 1) AS BIGINT) ELSE 100 + ascii(substr({r}, i, 1)) - 55 END)")
        fold = (f"list_reduce(list_prepend(CAST(0 AS BIGINT), {code}), lambda acc, x: CASE WHEN x >= 100 "
                f"THEN (acc * 100 + x - 100) % 97 ELSE (acc * 10 + x) % 97 END)")
        return f"(length({s}) >= 15 AND {fold} = 1)"
    if name == "aba":
        return f"(length({d}) = 9 AND {_weighted(d, [3, 7, 1, 3, 7, 1, 3, 7, 1])} % 10 = 0)"
    if name == "nhs":
        rest = f"({_weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11)"
        chk = f"(CASE WHEN {rest} = 0 THEN 0 ELSE 11 - {rest} END)"
        return f"(length({d}) = 10 AND {chk} <> 10 AND {chk} = {_dig(d, '10')})"
    if name == "tfn":
        return f"(length({d}) = 9 AND {_weighted(d, [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0)"
    if name == "medicare":
        return (f"(length({d}) = 10 AND substr({d}, 1, 1) IN ('2','3','4','5','6') AND "
                f"{_weighted(d, [1, 3, 7, 9, 1, 3, 7, 9])} % 10 = {_dig(d, '9')})")
    if name == "ssn":
        return (f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' "
                f"AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')")
    if name == "itin":
        mid = f"CAST(substr({d}, 4, 2) AS INT)"
        return (f"(length({d}) = 9 AND substr({d}, 1, 1) = '9' AND ({mid} BETWEEN 50 AND 65 OR {mid} BETWEEN 70 "
                f"AND 88 OR {mid} BETWEEN 90 AND 92 OR {mid} BETWEEN 94 AND 99))")
    if name == "ipv4":
        return (f"(len(string_split({x}, '.')) = 4 AND list_bool_and(list_transform(string_split({x}, '.'), "
                f"lambda p: CAST(p AS INT) <= 255)))")
    raise KeyError(name)


def _score_sql(rec: R.Recognizer) -> str:
    base = f"CAST({float(rec.score)!r} AS DOUBLE)"
    if not rec.context:
        return base
    near = 'lower(substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)))'
    return (f"least(CAST(1.0 AS DOUBLE), {base} + CASE WHEN regexp_matches({near}, {q(rec.context)}) "
            f"THEN {R.CONTEXT_BOOST!r} ELSE 0.0 END)")


def lane_ctes(lane: str, recs: list[R.Recognizer], src: str, id_cols: tuple[str, ...]) -> list[tuple[str, str]]:
    """CTEs ``<lane>_m`` (matches), ``<lane>_c`` (candidate spans)."""
    pattern, group = R.lane_pattern(lane, recs)
    pre = R.lane_prefilter(lane, recs)
    ids = ", ".join(id_cols)
    where = f"WHERE regexp_matches(text, {q(pre)})" if pre else ""
    m = (f"SELECT {ids}, text, g, m, unnest(range(1, len(m) + 1)) AS k FROM ("
         f"SELECT {ids}, text, string_split_regex(text, {q(pattern)}) AS g, "
         f"regexp_extract_all(text, {q(pattern)}, 0) AS m FROM {src} {where}) x")
    endexpr = ("coalesce(list_sum(list_transform(g[1:k], lambda s: length(s))), 0) + "
               "coalesce(list_sum(list_transform(m[1:k], lambda s: length(s))), 0)")
    val = f"regexp_extract(m[k], {q(pattern)}, {group})" if group else "m[k]"
    c = (f"SELECT {ids}, text, CAST(e - length(v) AS INT) AS start, CAST(e AS INT) AS \"end\", v AS tok, "
         f"CAST(e - length(m[k]) AS INT) AS mstart "
         f"FROM (SELECT *, {endexpr} AS e, {val} AS v FROM {lane}_m) y")
    edge = R.head_edge(lane, recs)
    conds = []
    if edge:
        conds.append(f"NOT regexp_matches(CASE WHEN mstart <= 0 THEN '' ELSE substr(text, mstart, 1) END, {q(edge)})")
    if lane in R.LANE_PATTERN or recs[0].tail_guard:
        conds.append(f"NOT regexp_matches(substr(text, \"end\" + 1, 1), {q(R.TOKEN_EDGE)})")
    if conds:
        c = f"SELECT * FROM ({c}) z WHERE " + " AND ".join(conds)
    return [(f"{lane}_m", m), (f"{lane}_c", c)]


def label_sql(lane: str, rec: R.Recognizer, id_cols: tuple[str, ...]) -> str:
    ids = ", ".join(id_cols)
    conds = []
    if rec.full:
        conds.append(f"regexp_matches(tok, {q(rec.full)})")
    if rec.check_name:
        conds.append(check_sql(rec.check_name, "tok"))
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    return (f"SELECT {ids}, {q(rec.entity_type)} AS entity_type, start, \"end\", {_score_sql(rec)} AS score, "
            f"tok AS text FROM {lane}_c {where}")


def spans_sql(entities=None, threshold: float | None = 0.7, src: str = "documents",
              id_cols: tuple[str, ...] = ("doc_id",), src_sql: str | None = None) -> tuple[list[tuple[str, str]], str]:
    """(ctes, select) producing ``(id..., entity_type, start, end, score, text)``."""
    recs = R.select(entities)
    ctes: list[tuple[str, str]] = []
    if src_sql is not None:
        ctes.append((src, src_sql))
    selects = []
    for lane, rs in R.lanes(recs).items():
        ctes += lane_ctes(lane, rs, src, id_cols)
        selects += [label_sql(lane, r, id_cols) for r in rs]
    body = " UNION ALL ".join(selects)
    where = f" WHERE score >= {float(threshold)!r}" if threshold is not None else ""
    return ctes, f"SELECT * FROM ({body}) s{where}"


def spans_view(entities=None, threshold=0.7, name="spans", src="documents", id_cols=("doc_id",),
               src_sql=None) -> list[tuple[str, str]]:
    ctes, sel = spans_sql(entities, threshold, src, id_cols, src_sql)
    return ctes + [(name, sel)]


def ctes_sql(ctes: list[tuple[str, str]], body: str, *views: str) -> str:
    return with_views(body, *views, extra=ctes)


# ---------------------------------------------------------------------------
# policy rules and masks in DuckDB (twins of functions/policy.py, masks.py)
# ---------------------------------------------------------------------------

def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_has_name(t: str) -> str:
    return f"(list_contains({t}, 'PERSON') OR (list_contains({t}, 'FIRST_NAME') AND list_contains({t}, 'LAST_NAME')))"


def sql_any(t: str, values) -> str:
    return f"list_has_any({t}, {lst(values)})"


def sql_sensitive(t: str) -> str:
    from ..functions import policy as P
    return sql_any(t, P.SENSITIVE_TYPES)


def sql_cred(t: str) -> str:
    from ..functions import policy as P
    return f"({sql_any(t, P.LOGIN_TYPES)} AND {sql_any(t, P.SECRET_TYPES)})"


def sql_trigger(t: str) -> str:
    return f"(({sql_has_name(t)} AND {sql_sensitive(t)}) OR {sql_cred(t)})"


def sql_components(t: str) -> str:
    from ..functions import policy as P
    n = sql_has_name(t)
    parts = [f"CASE WHEN {sql_cred(t)} THEN 'CREDS' END",
             f"CASE WHEN {n} AND {sql_any(t, P.SSN_TYPES)} THEN 'PII-SSN' END",
             f"CASE WHEN {n} AND {sql_any(t, P.FINANCIAL_TYPES)} THEN 'PII-FIN' END",
             f"CASE WHEN {n} AND {sql_any(t, P.GOV_ID_TYPES)} THEN 'PII-GOV' END",
             f"CASE WHEN {n} AND {sql_any(t, P.HEALTH_TYPES)} THEN 'PII-MED' END"]
    specific = f"len(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"
    gen = f"CASE WHEN {n} AND {sql_sensitive(t)} AND {specific} = 0 THEN 'PII-GEN' END"
    return f"list_filter([{', '.join(parts + [gen])}], lambda x: x IS NOT NULL)"


def sql_label(t: str) -> str:
    c = sql_components(t)
    return f"(CASE WHEN len({c}) > 1 THEN 'HIGH-RISK' WHEN len({c}) = 1 THEN ({c})[1] ELSE 'UNKNOWN' END)"


def sql_reasons(t: str) -> str:
    return (f"list_filter([CASE WHEN {sql_has_name(t)} AND {sql_sensitive(t)} THEN 'personal_info_with_sensitive_data' END, "
            f"CASE WHEN {sql_cred(t)} THEN 'credential_pair' END], lambda x: x IS NOT NULL)")


def sql_set_tier(t: str) -> str:
    from ..functions import policy as P
    return (f"(CASE WHEN {sql_any(t, P.RESTRICTED)} THEN 3 WHEN {sql_any(t, P.CONFIDENTIAL)} THEN 2 "
            f"WHEN {sql_any(t, P.INTERNAL)} THEN 1 ELSE 0 END)")


def sql_type_tier(x: str) -> str:
    from ..functions import policy as P
    return (f"(CASE WHEN {x} IN ({', '.join(q(v) for v in P.RESTRICTED)}) THEN 3 "
            f"WHEN {x} IN ({', '.join(q(v) for v in P.CONFIDENTIAL)}) THEN 2 "
            f"WHEN {x} IN ({', '.join(q(v) for v in P.INTERNAL)}) THEN 1 ELSE 0 END)")


def sql_pick(values, idx: str) -> str:
    return f"({lst(values)})[{idx} + 1]"


def sql_display(x: str, names: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in names.items())
    return f"(CASE {x} {whens} ELSE {x} END)"


def _inl(values) -> str:
    return ", ".join(q(v) for v in values)


def _words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def sql_mask_strict(x: str, t: str) -> str:
    from ..functions import policy as P
    dom = f"substr({x}, strpos({x}, '@') + 1)"
    user = f"split_part({x}, '@', 1)"
    w = _words_sql(x)
    return f"""(CASE
  WHEN {t} IN ({_inl(P.SENSITIVE_TYPES)}) THEN CASE WHEN length({x}) > 4 THEN '****' || right({x}, 4) ELSE '****' END
  WHEN {t} IN ('EMAIL_ADDRESS', 'USERNAME') THEN CASE
     WHEN strpos({x}, '@') > 0 THEN CASE WHEN length({user}) > 2 THEN left({x}, 1) || '***@' || {dom} ELSE '***@' || {dom} END
     WHEN length({x}) > 4 THEN left({x}, 1) || '***' || right({x}, 1) ELSE '****' END
  WHEN {t} IN ('PERSON', 'FIRST_NAME', 'LAST_NAME') THEN CASE
     WHEN len({w}) > 1 THEN array_to_string(list_transform({w}, lambda p: left(p, 1) || '.'), ' ')
     WHEN length({x}) > 0 THEN left({x}, 1) || '.' ELSE '****' END
  ELSE CASE WHEN length({x}) > 4 THEN left({x}, 1) || '***' || right({x}, 1) ELSE '****' END END)"""


def sql_mask_tiered(x: str, t: str) -> str:
    from ..functions import policy as P
    n = f"length({x})"
    w = _words_sql(x)
    user = f"split_part({x}, '@', 1)"
    dom = f"substr({x}, strpos({x}, '@') + 1)"
    return f"""(CASE
  WHEN {x} IS NULL OR {n} = 0 THEN ''
  WHEN {t} IN ({_inl(P.TIER_FULL_MASK)}) THEN '********'
  WHEN {t} IN ('PERSON', 'FIRST_NAME', 'LAST_NAME') THEN CASE
     WHEN len({w}) = 1 THEN CASE WHEN {n} <= 2 THEN left({x}, 1) || '*' ELSE left({x}, 1) || repeat('*', {n} - 1) END
     ELSE array_to_string(list_transform({w}, lambda p: CASE WHEN length(p) <= 1 THEN p
            ELSE left(p, 1) || repeat('*', length(p) - 1) END), ' ') END
  WHEN {t} IN ({_inl(P.TIER_LAST4_MASK)}) THEN CASE WHEN {n} <= 4 THEN repeat('*', {n})
     ELSE repeat('*', {n} - 4) || right({x}, 4) END
  WHEN {t} = 'EMAIL_ADDRESS' AND strpos({x}, '@') > 0 THEN
     (CASE WHEN length({user}) <= 2 THEN {user} ELSE left({user}, 1) || repeat('*', length({user}) - 2) || right({user}, 1) END)
     || '@' || {dom}
  ELSE CASE WHEN {n} <= 2 THEN {x} ELSE left({x}, 1) || repeat('*', {n} - 2) || right({x}, 1) END END)"""


def sql_mask_simple(x: str, t: str) -> str:
    from ..functions import policy as P
    parts = f"string_split({x}, '@')"
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    w = _words_sql(x)
    return f"""(CASE
  WHEN {t} IN ({_inl(P.SIMPLE_LAST4_MASK)}) THEN CASE WHEN length({x}) > 4 THEN '****' || right({x}, 4) ELSE '****' END
  WHEN {t} = 'EMAIL_ADDRESS' THEN CASE WHEN len({parts}) = 2 THEN
       CASE WHEN length({parts}[1]) > 2 THEN left({parts}[1], 2) || '***@' || {parts}[2] ELSE '***@' || {parts}[2] END
     ELSE '***@***' END
  WHEN {t} = 'PHONE_NUMBER' THEN CASE WHEN length({digits}) >= 4 THEN '***-***-' || right({digits}, 4) ELSE '***-***-****' END
  WHEN {t} = 'PERSON' THEN CASE WHEN len({w}) > 1 THEN left({w}[1], 1) || '. ' || {w}[-1] ELSE {x} END
  ELSE CASE WHEN length({x}) > 4 THEN left({x}, 1) || '***' || right({x}, 1) ELSE '****' END END)"""


LEDGER_FE = """
SELECT f.file_id, f.job_id, f.file_path, f.file_type, e.result_id, e.entity_type, e.start_index, e.end_index,
       e.score, e.text
FROM t_entities e
JOIN (SELECT file_id, min(result_id) AS result_id FROM t_results GROUP BY file_id) r ON e.result_id = r.result_id
JOIN t_files f ON r.file_id = f.file_id
WHERE f.status = 'completed' AND e.score >= 0.7"""

LEDGER_FS = """
SELECT file_id, file_path, list_sort(list(DISTINCT entity_type)) AS types, count(*) AS entity_count
FROM fe GROUP BY file_id, file_path"""


def ledger_sql(body: str, *more: tuple[str, str]) -> str:
    """Body over ``fe`` (entities >= 0.7 of completed files) and ``fs`` (sets)."""
    return with_views(body, "t_files", "t_results", "t_entities",
                      extra=[("fe", LEDGER_FE), ("fs", LEDGER_FS), *more])
