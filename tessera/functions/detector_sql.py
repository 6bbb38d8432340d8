"""The detector as one Spark SQL expression.

Building the detector with the Column API would cost tens of thousands of
py4j calls (every lambda is created in the JVM); written as Spark SQL text it
is parsed by Catalyst in one call.  A lane is one regex pass (two built-ins
that cut the text the same way); its candidates carry the characters around
them, so edges and context are checked without going back to the text.
"""

from __future__ import annotations

import itertools

from . import recognizers as R
from .spans import SCAN_BLOCK
from .strings import SPACE

SPAN_TYPE = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"

_ids = itertools.count()


def _v(prefix: str) -> str:
    return f"{prefix}{next(_ids)}"


def lit(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dbl(x: float) -> str:
    return f"{float(x)!r}D"


def scan(values: str, zero: str, op) -> str:
    """SQL twin of ``functions.spans.scan``; ``values`` is evaluated once."""
    v, b, blk, t, acc, head, x, j, w = (_v(n) for n in ("v", "b", "blk", "t", "acc", "head", "x", "j", "w"))
    s1, s2, e1, e2 = _v("s"), _v("s"), _v("e"), _v("e")
    blocks = (f"transform(sequence(0, CAST(greatest(size({v}) - 1, 0) AS INT) div {SCAN_BLOCK}), "
              f"{b} -> slice({v}, CAST({b} * {SCAN_BLOCK} + 1 AS INT), {SCAN_BLOCK}))")
    totals = f"transform({w}, {t} -> aggregate({t}, {zero}, ({s1}, {e1}) -> {op(s1, e1)}))"
    heads = (f"aggregate({totals}, array({zero}), "
             f"({acc}, {x}) -> concat({acc}, array({op(f'element_at({acc}, -1)', x)})))")
    inner = (f"transform({blk}, ({x}, {j}) -> aggregate(slice({blk}, 1, {j}), {head}, "
             f"({s2}, {e2}) -> {op(s2, e2)}))")
    scanned = f"flatten(zip_with({w}, slice({heads}, 1, size({w})), ({blk}, {head}) -> {inner}))"
    return f"transform(array({values}), {v} -> transform(array({blocks}), {w} -> {scanned})[0])[0]"


def regex_spans(t: str, pattern: str, group: int = 0) -> str:
    """array<struct<start, end, text, prev, next, near>> of every match.

    ``split`` gives the m + 1 gaps around the m matches that
    ``regexp_extract_all`` returns; the start of a match is the length of all
    before it (a scan).  ``prev`` and ``next`` are the characters around the
    whole match, ``near`` the characters before it; they come from the gaps
    and matches themselves, so no position is looked up in the text again.
    A group other than 0 must be the last thing in the pattern.
    """
    p = lit(pattern)
    z, m, i, c, q = (_v(n) for n in ("z", "m", "i", "c", "q"))
    cut = f"named_struct('g', split({t}, {p}, -1), 'm', regexp_extract_all({t}, {p}, 0))"
    steps = f"transform({z}.m, ({m}, {i}) -> length(get({z}.g, {i})) + length({m}))"
    tails = f"transform({z}.m, ({m}, {i}) -> right(concat(get({z}.g, {i}), {m}), {R.CONTEXT_WIDTH}))"
    before = scan(tails, "''", lambda x, y: f"right(concat({x}, {y}), {R.CONTEXT_WIDTH})")
    value = f"regexp_extract({m}, {p}, {group})" if group else m
    begin = f"(get({c}.pos, {i}) + length(get({z}.g, {i})))"
    near = f"right(concat(get({c}.tail, {i}), get({z}.g, {i})), {R.CONTEXT_WIDTH})"
    after = (f"CASE WHEN get({z}.g, {i} + 1) = '' THEN left(coalesce(get({z}.m, {i} + 1), ''), 1) "
             f"ELSE left(get({z}.g, {i} + 1), 1) END")
    span = (f"named_struct('start', CAST({begin} + length({m}) - length({value}) AS INT), "
            f"'end', CAST({begin} + length({m}) AS INT), 'text', {value}, "
            f"'prev', right({near}, 1), 'next', {after}, 'near', {near})")
    carried = f"named_struct('pos', {scan(steps, '0', lambda x, y: f'{x} + {y}')}, 'tail', {before})"
    spans = f"transform({z}.m, ({m}, {i}) -> {span})"
    return f"transform(array({cut}), {z} -> transform(array({carried}), {c} -> {spans})[0])[0]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _dig(d: str, i: str) -> str:
    return f"CAST(substr({d}, {i}, 1) AS INT)"


def _weighted(d: str, weights: list[int]) -> str:
    i, a, b = _v("i"), _v("a"), _v("b")
    w = "array(" + ", ".join(str(v) for v in weights) + ")"
    digs = f"transform(sequence(1, length({d})), {i} -> {_dig(d, i)})"
    a2, b2 = _v("a"), _v("b")
    return (f"aggregate(zip_with({digs}, {w}, ({a}, {b}) -> coalesce({a} * {b}, 0)), 0, "
            f"({a2}, {b2}) -> {a2} + {b2})")


def check_sql(name: str, x: str) -> str:
    d = _digits(x)
    if name == "luhn":
        i, a, b = _v("i"), _v("a"), _v("b")
        dv = _dig(d, i)
        term = f"CASE WHEN (length({d}) - {i}) % 2 = 1 THEN (CASE WHEN {dv} * 2 > 9 THEN {dv} * 2 - 9 ELSE {dv} * 2 END) ELSE {dv} END"
        return (f"(length({d}) >= 2 AND aggregate(transform(sequence(1, length({d})), {i} -> {term}), 0, "
                f"({a}, {b}) -> {a} + {b}) % 10 = 0)")
    if name == "iban":
        s = f"upper(regexp_replace({x}, '[^A-Za-z0-9]', ''))"
        r = f"concat(substr({s}, 5, length({s})), substr({s}, 1, 4))"
        i, acc, ch = _v("i"), _v("acc"), _v("ch")
        chars = f"transform(sequence(1, length({r})), {i} -> substr({r}, {i}, 1))"
        fold = (f"aggregate({chars}, CAST(0 AS BIGINT), ({acc}, {ch}) -> CASE WHEN {ch} RLIKE '^[0-9]$' "
                f"THEN ({acc} * 10 + CAST({ch} AS BIGINT)) % 97 ELSE ({acc} * 100 + CAST(ascii({ch}) - 55 AS BIGINT)) % 97 END)")
        return f"(length({s}) >= 15 AND {fold} = 1)"
    if name == "aba":
        return f"(length({d}) = 9 AND {_weighted(d, [3, 7, 1, 3, 7, 1, 3, 7, 1])} % 10 = 0)"
    if name == "nhs":
        rest = f"({_weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2, 0])} % 11)"
        chk = f"(CASE WHEN {rest} = 0 THEN 0 ELSE 11 - {rest} END)"
        return f"(length({d}) = 10 AND {chk} <> 10 AND {chk} = {_dig(d, '10')})"
    if name == "tfn":
        return f"(length({d}) = 9 AND {_weighted(d, [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0)"
    if name == "medicare":
        return (f"(length({d}) = 10 AND substr({d}, 1, 1) IN ('2', '3', '4', '5', '6') AND "
                f"{_weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 0, 0])} % 10 = {_dig(d, '9')})")
    if name == "ssn":
        return (f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND NOT startswith(substr({d}, 1, 3), '9') "
                f"AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')")
    if name == "itin":
        mid = f"CAST(substr({d}, 4, 2) AS INT)"
        return (f"(length({d}) = 9 AND substr({d}, 1, 1) <=> '9' AND ({mid} BETWEEN 50 AND 65 OR {mid} BETWEEN 70 "
                f"AND 88 OR {mid} BETWEEN 90 AND 92 OR {mid} BETWEEN 94 AND 99))")
    if name == "ipv4":
        p = _v("p")
        parts = f"split({x}, '\\\\.', -1)"
        return f"(size({parts}) = 4 AND forall({parts}, {p} -> CAST({p} AS INT) <= 255))"
    raise KeyError(name)


def _score(rec: R.Recognizer, c: str) -> str:
    base = dbl(rec.score)
    if not rec.context:
        return base
    near = f"lower({c}.near)"
    return f"least(1.0D, {base} + CASE WHEN {near} RLIKE {lit(rec.context)} THEN {dbl(R.CONTEXT_BOOST)} ELSE 0.0D END)"


def _label(rec: R.Recognizer, c: str) -> str:
    conds = []
    if rec.full:
        conds.append(f"{c}.text RLIKE {lit(rec.full)}")
    if rec.check_name:
        conds.append(check_sql(rec.check_name, f"{c}.text"))
    ok = " AND ".join(conds) if conds else "true"
    span = (f"named_struct('entity_type', {lit(rec.entity_type)}, 'start', {c}.start, 'end', {c}.end, "
            f"'score', {_score(rec, c)}, 'text', {c}.text)")
    return f"CASE WHEN {ok} THEN {span} END"


def lane_sql(t: str, lane: str, recs: list[R.Recognizer]) -> str:
    pattern, group = R.lane_pattern(lane, recs)
    cands = regex_spans(t, pattern, group)
    edge = R.head_edge(lane, recs)
    if edge:
        c = _v("c")
        cands = f"filter({cands}, {c} -> NOT ({c}.prev RLIKE {lit(edge)}))"
    if lane in R.LANE_PATTERN or recs[0].tail_guard:
        c = _v("c")
        cands = f"filter({cands}, {c} -> NOT ({c}.next RLIKE {lit(R.TOKEN_EDGE)}))"
    c, s = _v("c"), _v("s")
    labels = ", ".join(_label(r, c) for r in recs)
    labelled = f"flatten(transform({cands}, {c} -> filter(array({labels}), {s} -> {s} IS NOT NULL)))"
    pre = R.lane_prefilter(lane, recs)
    if pre:
        labelled = f"CASE WHEN {t} RLIKE {lit(pre)} THEN {labelled} ELSE CAST(array() AS {SPAN_TYPE}) END"
    return labelled


def _guard(t: str, guard: str) -> str | None:
    if guard == "sep":
        return f"(contains({t}, ':') OR contains({t}, '=') OR contains({t}, '#'))"
    if guard == "digit":
        return f"({t} RLIKE '[0-9]')"
    if guard == "at":
        return f"contains({t}, '@')"
    return None


def spans_sql(text_col: str, entities=None, threshold: float | None = 0.7) -> str:
    """Spark SQL text of ``operators.detect.build_spans_column``."""
    t = f"`{text_col}`"
    empty = f"CAST(array() AS {SPAN_TYPE})"
    groups: dict[str, list[str]] = {}
    for lane, rs in R.lanes(R.select(entities)).items():
        groups.setdefault(R.lane_guard(lane), []).append(lane_sql(t, lane, rs))
    parts = []
    for guard, cols in groups.items():
        arr = f"concat({', '.join(cols)})" if len(cols) > 1 else cols[0]
        g = _guard(t, guard)
        parts.append(arr if g is None else f"CASE WHEN {g} THEN {arr} ELSE {empty} END")
    allspans = f"concat({', '.join(parts)})" if len(parts) > 1 else (parts[0] if parts else empty)
    if threshold is not None:
        s = _v("s")
        allspans = f"filter({allspans}, {s} -> {s}.score >= {dbl(threshold)})"
    allspans = f"CASE WHEN coalesce(length(btrim({t}, {lit(SPACE)})), 0) = 0 THEN {empty} ELSE {allspans} END"
    a, b = _v("a"), _v("b")
    cmp = (f"({a}, {b}) -> CASE WHEN {a}.start < {b}.start THEN -1 WHEN {a}.start > {b}.start THEN 1 "
           f"WHEN {a}.end < {b}.end THEN -1 WHEN {a}.end > {b}.end THEN 1 "
           f"WHEN {a}.entity_type < {b}.entity_type THEN -1 WHEN {a}.entity_type > {b}.entity_type THEN 1 ELSE 0 END")
    return f"array_sort({allspans}, {cmp})"
