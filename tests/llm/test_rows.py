"""Operators that work text by text: BPE, packing, quality, toxicity."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, quality, toxicity, words as W

from .conftest import clashing, words, prose


def fuzz(n):
    r = random.Random(2)
    letters = [*"ab '\n\t ", " ", "　", "é", "日", "1", "!", "😀", "<|endoftext|>", "'ll", "İ", "Σ", "ß", "AB", "\x1c"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = fuzz(500) + ["a" * 3000, "aab" * 500]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: list(r.ids) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want


def test_bpe_edge_cases(odd_docs, no_docs):
    rows = bpe.round_trip(clashing(odd_docs)).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(no_docs).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd_docs)).collect()}
    assert back == texts


def check_pieces(rows, texts, size):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    padding = 0
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        n = sum(r.length for r in pieces)
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding


@pytest.mark.parametrize("stretch", [1 << 20, 3000])
def test_packing(spark, odd_docs, no_docs, monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    one = odd_docs.dropDuplicates(["doc_id"])
    rows = packing.pack(clashing(one).coalesce(1)).collect()
    texts = {r.doc_id: r.text for r in one.collect()}
    padding = check_pieces(rows, texts, 4096)
    assert padding < 0.05 * sum(r.length for r in rows)
    assert packing.pack(no_docs).count() == 0
    more = {i: t for i, t in enumerate(fuzz(300))}
    rows = packing.pack(spark.createDataFrame(list(more.items()), "doc_id long, text string"), size=64).collect()
    check_pieces(rows, more, 64)


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(3)
    for _ in range(60):
        at = np.concatenate(([0], np.cumsum(r.integers(1, 6, 14))))
        price = r.integers(0, 4, 15)
        size = int(r.integers(6, 20))
        best = [0.0] + [1e9] * 14

        def cost(n):
            return 0 if n & (n - 1) == 0 else size - n
        for j in range(1, 15):
            best[j] = min(best[i] + cost(int(at[j] - at[i])) + price[j] for i in range(j) if at[j] - at[i] <= size)
        cuts = packing.best_cuts(at, price, size)
        value = sum(cost(int(at[j] - at[i])) + price[j] for i, j in zip([0, *cuts], cuts))
        assert cuts[-1] == 14 and value == best[14]


def brute_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    r = random.Random(4)
    for i in range(100, 200):
        texts[i] = "".join(r.choice(["ab ", "b ", "ab\n", "# ", "é| ", "\n", " "]) for _ in range(r.randint(0, 60)))
    docs = spark.createDataFrame([(i, t, "xx", None) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string")
    for row in quality.measure(clashing(docs)).collect():
        assert tuple(row[c] for c in quality.COUNTS[:5]) == brute_counts(texts[row.doc_id])
    rows = quality.apply_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.apply_rules(no_docs).count() == 0


def test_quality_thresholds_adapt(spark):
    r = random.Random(8)

    def text(symbols):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + ("#" if r.random() < symbols else "")
                        for _ in range(80))
    rows = [(i, text(0.9), "en", "code") for i in range(100)] + [(100 + i, text(0), "en", "prose") for i in range(100)]
    rows.append((500, text(0.9), "en", "prose"))
    got = {x.doc_id: x.kept for x in quality.apply_rules(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(500) and sum(got.values()) >= 195


def brute_verdicts(rows):
    """kept, from exact quantiles of each group (of 50 base-passing documents or more)."""
    facts, out = {}, {}
    for i, text, lang, source in rows:
        n, chars, symbols, dup, repeat = brute_counts(text)
        lines = sum(bool(words(x)) for x in text.split("\n"))
        letters = [c for c in text if c.isascii() and c.isalpha()]
        rates = (symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1), sum(c.isupper() for c in letters) / max(len(letters), 1))
        facts[i] = (lang, source), n < 50 or 100 * repeat > 50 * n, rates
    for i, (group, failed, rates) in facts.items():
        ok = not failed
        for k, (far, least) in enumerate(quality.RATES.values()):
            v = sorted(r[k] for g, f, r in facts.values() if g == group and not f)
            if v:
                at = [v[max(math.ceil(q * len(v)) - 1, 0)] for q in (0.5, far)]
                ok = ok and rates[k] <= max(least, at[1] + quality.SPREADS * (at[1] - at[0]))
        out[i] = ok
    return out


def test_quality_verdicts_match_brute_force(spark):
    """Exact quantiles of small groups; every rate rejects what stands out in its group."""
    r, rows = random.Random(12), []
    for g, (lang, source, noise) in enumerate((("en", "a", 0.0), ("en", "b", 0.06), ("de", None, 0.02))):
        for i in range(120):
            w = prose(40_000 + 1000 * g + i, r.randint(60, 160)).split()
            w = [x.upper() if r.random() < noise else x for x in w]
            w = [x + "#" if r.random() < noise else x for x in w]
            rows.append((1000 * g + i, "\n".join(" ".join(w[j:j + 10]) for j in range(0, len(w), 10)), lang, source))
        clean = prose(50_000 + g, 100).split()
        text = "\n".join(" ".join(clean[j:j + 5]) for j in range(0, 100, 5))
        odd = [text.replace(" ", " ### "), "\n".join([text, *["said again and so on"] * 14]), text.upper(),
               " ".join([*clean[:90], *clean[:10] * 4])]
        rows += [(1000 * g + 900 + k, t, lang, source) for k, t in enumerate(odd)]
    got = {x.doc_id: x.kept for x in quality.apply_rules(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert got == brute_verdicts(rows)
    assert not any(got[900 + k] for k in range(4))  # symbols, lines, capitals, repeated words
    assert sum(got.values()) > 330


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(5)
    score, trans, length = r.normal(size=9), r.normal(size=(2, 2)), np.array([4, 1, 4])
    first = np.array([0, 4, 5])
    got, pairs = toxicity.forward_backward(score, first, length, trans)
    want, both = np.zeros(9), np.zeros((2, 2))
    for f, n in zip(first, length):
        total, m, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(2 ** n):
            y = [(bits >> k) & 1 for k in range(n)]
            weight = np.exp(sum(score[f + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += weight
            m += weight * np.array(y)
            for k in range(n - 1):
                p[y[k], y[k + 1]] += weight
        want[f:f + n] = m / total
        both += p / total
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_toxicity_on_held_out(spark, odd_docs, no_docs):
    r = random.Random(6)
    bad = ["zounds", "fiddlesticks", "blastings"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice("abcdefghijklmnop") * r.randint(1, 3) + r.choice(["ent", "ing", "or"]) for _ in range(60)]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(60)] = r.choice(bad) + r.choice(["", ",", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, learn=~toxicity.held_out())
    got = {x.doc_id: x for x in toxicity.score(clashing(docs), model).collect()}
    wrong = [i for i, t in labels if (got[i].score >= toxicity.THRESHOLD) != bool(t)]
    assert len(wrong) <= 6
    spans = [(rows[i][1][s.start:s.end]) for i, t in labels if t for s in got[i].spans]
    assert spans and sum(s in bad for s in spans) >= 0.9 * len(spans)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.clean(clashing(docs), model).count() == sum(
        x.score < toxicity.THRESHOLD for x in got.values())
    none = toxicity.train(no_docs, marks)
    assert all(x.score < toxicity.THRESHOLD for x in toxicity.score(odd_docs, none).collect())


def test_long_text_is_one_piece():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (3 * W.PIECE_BYTES), None, "y"])], names=["text"])
    assert [p.num_rows for p in W.pieces(batch)] == [1, 2]


def test_other_column_names(spark):
    from tessera.llm import jaccard, linededup, substring
    docs = spark.createDataFrame([(1, "some words to read, and more"), (2, None)], "id int, body string")
    names = {"id_col": "id", "text_col": "body"}
    assert bpe.round_trip(docs, **names).count() == 2 and packing.pack(docs, **names).count() == 2
    assert jaccard.jaccard_groups(docs, **names).count() == 2 and substring.repeated_passages(docs, **names).count() == 0
    assert linededup.dedup_lines(docs, **names).columns == ["id", "body", "n_removed"]
    assert toxicity.score(docs, toxicity.train(docs, docs.selectExpr("id AS doc_id", "1 AS toxic"), **names), **names).count() == 2
    tagged = docs.selectExpr("id", "body", "'x' AS l", "null AS s")
    assert quality.apply_rules(tagged, lang_col="l", source_col="s", **names).count() == 2
