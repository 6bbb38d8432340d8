"""Jaccard groups, repeated passages and line dedup against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import jaccard, linededup, substring

from .conftest import clashing, lower, prose, words


def brute_groups(rows, k=5, percent=80):
    sets, out = {}, {}
    for i, text in rows:
        w = words(lower(text))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                group[b] = a
    for i in ids:
        out[i] = (len(sets[i]), root(i))
    return out


def test_groups_match_brute_force(spark):
    r = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = prose(g, r.choice([3, 5, 6, 9, 40, 120])).split()
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["Changed", "words", "HERE"])
            n += 1
            rows.append((n * 3 % 101, " ".join(w) + r.choice(["", "\n", " tail of it"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_groups(df).collect()}
    assert got == brute_groups(rows)


def test_hot_group_stays_linear(spark, monkeypatch):
    base = prose(9, 200).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[(7 * i) % 200] = f"own{i}"
        w[(11 * i + 5) % 200] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows.append((300, " ".join(base)))
    seen = []
    real = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    got = {x.component_id for x in jaccard.jaccard_groups(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {0}
    assert sum(t.count() for name, t in seen if name == "pairs") < 20 * len(rows)


def test_groups_edge_cases(odd_docs, no_docs):
    rows = jaccard.jaccard_groups(clashing(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == by[3].component_id == 1 and by[12].component_id == 12
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[5].component_id == 5
    assert by[8].n_shingles == 1 and by[8].component_id == 8 and by[None].component_id is None
    assert by[9].n_shingles == 1
    assert jaccard.jaccard_groups(no_docs).count() == 0
    assert jaccard.one_of_each(clashing(odd_docs)).count() == jaccard.one_of_each(odd_docs).count()
    kept = sorted(str(r.doc_id) for r in jaccard.one_of_each(odd_docs).collect())
    assert kept == sorted(map(str, [1, 4, 5, 6, 7, 8, None, 9, 10, 11, 12]))


def test_passages_found(spark):
    r = random.Random(3)
    passage = prose(77, 60).split()
    fuzzy = list(passage)
    fuzzy[20], fuzzy[41] = "swapped", "again"
    del fuzzy[30]
    rows = [(i, prose(100 + i, r.randint(60, 150))) for i in range(30)]
    for i, p in ((4, passage), (9, passage), (17, fuzzy)):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:40] + p + w[40:]))
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.doc_id, x.source_id) for x in found} == {(9, 4), (17, 4)}
    spans = {x.doc_id: x for x in found}
    assert abs(spans[9].start_word - 40) <= 1 and abs(spans[9].end_word - 100) <= 1 and spans[9].identity > 0.97
    assert spans[17].start_word <= 42 and spans[17].end_word >= 97 and 0.9 < spans[17].identity < 1


def test_chains_match_quadratic_search(monkeypatch):
    monkeypatch.setattr(substring, "MAX_GAP", 10 ** 6)
    r = np.random.default_rng(1)
    for _ in range(40):
        n = int(r.integers(2, 40))
        m = np.unique(r.integers(0, 60, (n, 2)), axis=0)
        b, a = m[:, 0], m[:, 1]
        best = []
        for i in range(len(m)):
            gain = max((best[j] - substring.GAP_COST * (a[i] + b[i] - a[j] - b[j])
                        for j in range(i) if b[j] < b[i] and a[j] < a[i]), default=0)
            best.append(substring.K + max(0, gain))
        chains = substring.best_chains(b, a)
        for c in chains:
            assert (np.diff(b[c]) > 0).all() and (np.diff(a[c]) > 0).all()
        if chains and max(best) > substring.K:
            top = max(chains, key=lambda c: substring.K * len(c) - substring.GAP_COST * (a[c[-1]] + b[c[-1]] - a[c[0]] - b[c[0]]))
            value = substring.K * len(top) - substring.GAP_COST * (a[top[-1]] + b[top[-1]] - a[top[0]] - b[top[0]])
            assert value == pytest.approx(max(best))


def test_passages_edge_cases(spark, odd_docs, no_docs):
    found = substring.repeated_passages(clashing(odd_docs))
    pairs = {(r.doc_id, r.source_id) for r in found.collect()}
    assert pairs == {(2, 1), (3, 1), (12, 1)}
    assert substring.repeated_passages(no_docs).count() == 0
    clash = substring.cut_passages(clashing(odd_docs), found, removed_col="gone")
    assert clash.columns == [*clashing(odd_docs).columns, "gone"] and all(r._spans == r._text == 7 for r in clash.collect())
    cut = {r.doc_id: r for r in substring.cut_passages(odd_docs, found, removed_col="gone").collect()}
    assert {r.doc_id: (r.text, r.gone) for r in clash.collect()} == {i: (r.text, r.gone) for i, r in cut.items()}
    assert words(cut[2].text) == [] and words(cut[3].text) == ["one", "more"]
    assert cut[4].text is None and cut[6].text == " \n\t " and cut[7].gone == 0 and cut[1].gone == 0
    assert 155 <= len(words(cut[12].text)) <= 160


def edit1(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y)) <= 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute_lines(rows):
    first = {}
    for i, text in sorted(rows):
        for p, raw in enumerate(text.split("\n")):
            line = " ".join(lower(raw).split())
            if len(line) >= linededup.MIN_CHARS:
                first.setdefault(line, (i, p))
    late = {x for x in first for y in first if first[y] < first[x] and len(x) >= linededup.EDIT_CHARS
            and len(y) >= linededup.EDIT_CHARS and edit1(x, y)}
    out = {}
    for i, text in rows:
        kept = []
        for p, raw in enumerate(text.split("\n")):
            line = " ".join(lower(raw).split())
            if line not in first or (line not in late and first[line] == (i, p)):
                kept.append(raw)
        out[i] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    r = random.Random(11)
    pool = [prose(i, r.choice([1, 3, 6, 12, 40, 70])) for i in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            x = r.choice(pool)
            kind, at = r.randrange(5), r.randrange(len(x))
            lines.append([x, x.upper(), x[:at] + "é" + x[at + 1:], x[:at] + x[at + 1:], x[:at] + "ü" + x[at:]][kind])
        rows.append((i, "\n".join(lines)))
    got = {x.doc_id: x.text for x in linededup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_lines(rows)


def test_lines_edge_cases(odd_docs, no_docs):
    clash = linededup.dedup_lines(clashing(odd_docs))
    assert clash.columns == [*clashing(odd_docs).columns, "_n_removed"]
    assert all(r.n_removed == r._gone == 7 for r in clash.collect()) and clash.agg({"_n_removed": "sum"}).first()[0] > 0
    got = {r.doc_id: r for r in linededup.dedup_lines(odd_docs).collect()}
    assert {r.doc_id: r.text for r in clash.collect()} == {i: r.text for i, r in got.items()}
    assert got[10].text == "a\nthe very same line of text\nb" and got[10].n_removed == 1
    assert got[11].text == "end of it all, is it"
    assert got[4].text is None and got[5].text == "" and got[6].text == " \n\t " and got[2].text == ""
    assert got[None].n_removed == 0 and got[7].n_removed == 0
    assert linededup.dedup_lines(odd_docs).count() == odd_docs.count()
    assert linededup.dedup_lines(no_docs).count() == 0


def test_repeat_whose_parts_stand_in_earlier_documents(spark):
    rows = []
    for g in range(8):
        base = prose(600 + g, 60).split()
        parts = [base[:30], base[30:], base, prose(650 + g, 60).split(), base[:25], base[25:], base[10:40], base]
        rows += [(10 * g + i, " ".join([prose(1000 + 10 * g + i, 70), *p, prose(2000 + 10 * g + i, 70)]))
                 for i, p in enumerate(parts)]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x.doc_id, x.source_id) for x in found) == [(10 * g + 7, 10 * g + 2) for g in range(8)]
    for x in found:
        assert abs(x.start_word - 70) <= 1 and abs(x.end_word - 130) <= 1 and x.identity > 0.96


@pytest.mark.parametrize("cut", range(0, 8))
def test_repeat_that_goes_beyond_an_earlier_part(spark, cut):
    """Documents 0 and 2 hold the middle of a passage, 1 and 3 hold it whole:
    3 finds it in 1, however little the middle lacks."""
    rows = []
    for g in range(6):
        base = prose(900 + 10 * cut + g, 50).split()
        part = base[cut:50 - cut] if cut else base[:47]
        rows += [(10 * g + i, " ".join([prose(7000 + 100 * cut + 10 * g + i, 70), *p, prose(8000 + 100 * cut + 10 * g + i, 70)]))
                 for i, p in enumerate((part, base, part, base))]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    whole = {(x.doc_id, x.source_id) for x in found if x.end_word - x.start_word >= 50 and x.identity == 1}
    assert {(10 * g + 3, 10 * g + 1) for g in range(6)} <= whole


def test_passages_of_the_least_identity(spark):
    r, rows = random.Random(8), []
    for g in range(40):
        n = (50, 60, 80, 100)[g % 4]
        base = prose(3000 + g, n).split()
        other = list(base)
        for i in r.sample(range(1, n - 1), n // 5):
            other[i] = f"other{i}"
        rows += [(2 * g + i, " ".join([prose(4000 + 2 * g + i, 70), *p, prose(5000 + 2 * g + i, 70)]))
                 for i, p in enumerate((base, other))]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.doc_id, x.source_id) for x in found} == {(2 * g + 1, 2 * g) for g in range(40)}
    assert all(x.identity >= 0.8 and x.end_word - x.start_word >= 50 for x in found)


def test_extension_over_inserted_and_deleted_words():
    x = np.arange(1, 61)
    y = np.concatenate((x[:10], [100], x[10:30], x[32:]))
    assert substring._extend(x, y) == (60, 59, 58)


def test_copies_are_stored_as_chains_not_as_matches(spark, monkeypatch):
    text = prose(31, 400)
    seen, real = [], substring.stored
    monkeypatch.setattr(substring, "stored", lambda df, name: seen.append(real(df, name)) or seen[-1])
    monkeypatch.setattr(substring, "drop", lambda table: None)
    found = substring.repeated_passages(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string"))
    assert {(x.doc_id, x.source_id, x.end_word) for x in found.collect()} == {(i, 0, 400) for i in range(1, 20)}
    assert max(t.count() for t in seen) <= 5 * 20


def test_chains_and_extensions_of_many_at_once():
    r = np.random.default_rng(4)
    xs, ys = [], []
    for _ in range(400):
        x = r.integers(0, 30, int(r.integers(0, 64)))
        y = np.delete(np.where(r.random(len(x)) < 0.15, r.integers(0, 30, len(x)), x), r.integers(0, max(len(x), 1), len(x) // 20))
        xs.append(x)
        ys.append(np.concatenate((r.integers(0, 30, int(r.integers(0, 3))), y))[:64])
    xs.append(np.arange(200))
    ys.append(np.arange(1, 201))
    assert substring._extensions(xs, ys).tolist() == [list(substring._extend(x, y)) for x, y in zip(xs, ys)]
    pairs = [(np.cumsum(r.integers(0 if g % 4 == 0 else 1, 3 + 7 * (g % 9), n)), np.cumsum(r.integers(1, 3 + 7 * (g % 9), n)))
             for g, n in enumerate(r.integers(1, 30, 600))]
    tails = np.cumsum([len(x) for x, _ in pairs])
    heads = np.concatenate(([0], tails[:-1]))
    x, y = (np.concatenate(z) for z in zip(*pairs))
    plain, (at, lo, size) = substring._plain_chains(heads, tails, x, y)
    got = {}
    for first, rows in zip(lo, np.split(at, np.cumsum(size)[:-1])):
        got.setdefault(int(np.searchsorted(tails, first, "right")), []).append((x[rows].tolist(), y[rows].tolist()))
    assert 100 < plain.sum() < 600
    for g in np.flatnonzero(plain):
        b, a = pairs[g]
        want = [c[[0, -1]] if (a[c] - b[c] == a[c[0]] - b[c[0]]).all() else c for c in substring.best_chains(b, a)]
        assert sorted(got.get(g, [])) == sorted((b[c].tolist(), a[c].tolist()) for c in want)


def test_words_of_regions_are_shuffled_once_they_are_stored_not_before(spark, monkeypatch):
    text, plans, real = prose(32, 200), {}, substring.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return real(df, name)
    monkeypatch.setattr(substring, "stored", seen)
    rows = [(i, f"{prose(33 + i, 5)} {text}") for i in range(4)] + [(2, "another text under its id")]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {(x.doc_id, x.source_id, x.start_word, x.end_word) for x in found.collect()} >= {(i, 0, 5, 205) for i in (1, 3)}
    kinds = [line.strip(" :+-").split(" ")[0] for line in plans["words"]]
    above = kinds[:kinds.index("MapInArrow")]
    assert "Aggregate" not in above and "RepartitionByExpression" not in above
    assert "Join" not in kinds and kinds.count("RepartitionByExpression") == 1


def test_words_of_regions_of_a_repeated_id():
    import pyarrow as pa
    texts = {1: [prose(41, 90)], 2: [prose(42, 90), prose(43, 40), prose(44, 90)], 5: [prose(45, 90)]}
    wanted = {2: [{"lo": 0, "hi": 32}, {"lo": 32, "hi": 96}], 5: [{"lo": 64, "hi": 96}], 7: [{"lo": 0, "hi": 32}]}
    rows = []
    for i in (1, 2, 5, 7):
        rows += [(i, None, wanted[i])] if i in wanted else []
        rows += [(i, t, None) for t in texts.get(i, [])]
    kinds = pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def hashed(text, lo, hi):
        w = substring.W.Words(*substring.W.flat(pa.array([text])))
        return (w.hashes() >> np.uint64(32)).astype(np.uint32)[lo:hi].tobytes()
    want = {(i, w["lo"]): min(hashed(t, w["lo"], w["hi"]) for t in texts[i]) for i in (2, 5) for w in wanted[i]}
    for size in (1, 2, 3, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + size]), kinds)],
                                              names=["doc_id", "text", "wanted"]) for at in range(0, len(rows), size)]
        got = [x for b in substring._regions(iter(batches)) for x in b.to_pylist()]
        assert len(got) == len(want) and {(x["doc_id"], x["lo"]): x["words"] for x in got} == want
